"""Label normalisation over raw annotation labels."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.functions import labels as rules
from segmark.functions import presets as P
from segmark.functions import text
from segmark.operators import labels as ops
from segmark.suite import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(c: str, labels) -> str:
    return f"{c} in ({', '.join(_q(x) for x in labels)})"


def _table(name: str, mapping: Mapping[str, str]) -> str:
    rows = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in mapping.items())
    return f"{name} as (select * from (values {rows}) t(k, v))"


def _all(c: str, patterns) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, {_q(p)}, '', 'g')"
    return c


def _dropped(c: str, labels) -> str:
    return f"({c} = '' or {_in(c, labels)} or {_in(f'lower({c})', labels)} or {_in(f'lower({c})', P.SILENCE_LABELS)})"


_MARKUP = (
    r"(?s)\n.*",
    r"(?s)\[\[.*?\]\]",
    r"(?s)\[.*?\]",
    r"\[\[|\]\]|\[|\]",
    r"(?s)\(.*?\)",
    r"(?s)\*.*?\*",
    r"(?i)\b\w*pause\w*\b",
)


def stripped(c: str) -> str:
    return f"trim(regexp_replace({_all(f'nfc_normalize({c})', _MARKUP)}, '\\s+', ' ', 'g'))"


def identity(c: str) -> str:
    """SQL of the preset without tables."""
    x = f"replace({stripped(c)}, ' ', '')"
    return f"(select case when not {_dropped('x', P.NON_SPEECH_LABELS)} then x end from (select {x} as x))"


def _head(c: str, keys: str, wide: str = "true") -> str:
    return (
        f"case when {wide} and length({c}) > 1 and {c} not in (select k from {keys}) "
        f"and not contains({_q(P.VOWELS)}, {c}[1]) then {c}[1] else {c} end"
    )


_RAW = fx.with_views("raw_labels")


@query("q_strip_markup", _RAW + f" select utt, pos::bigint as pos, {stripped('label')} as label from raw_labels")
def q_strip_markup(spark, sf_dir):
    raw = fx.raw_labels(spark, sf_dir).withColumn("c", text.compose("label"))
    return raw.select(
        "utt", F.col("pos").cast("long").alias("pos"), rules.strip_annotation_markup(F.col("c.nfc")).alias("label")
    )


def _normalized(spark, sf_dir, rule_set):
    out = ops.normalize_labels(fx.raw_labels(spark, sf_dir), "label", rule_set)
    return out.select("utt", F.col("pos").cast("long").alias("pos"), "phoneme")


@query(
    "q_normalize_general",
    _RAW + f" select utt, pos::bigint as pos, {identity('label')} as phoneme from raw_labels",
)
def q_normalize_general(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.PRESETS["none"])


_FRENCH_DROP = (*P.NON_SPEECH_LABELS, *P.FILLER_LABELS)


@query(
    "q_normalize_french_reference",
    _RAW
    + f""", {_table("m", P.SAMPA_TO_IPA)}, {_table("canon", P.NASAL_CANONICAL)},
    a as (select utt, pos, replace({stripped("label")}, ' ', '') as x from raw_labels),
    b as (select *, {_head("x", "m")} as y from a),
    c as (select b.*, coalesce(m.v, y) as y1 from b left join m on m.k = y),
    d as (select c.*, replace(coalesce(canon.v, y1), 'ː', '') as z from c left join canon on canon.k = y1)
    select utt, pos::bigint as pos,
           case when not {_dropped("x", _FRENCH_DROP)} and not {_dropped("z", _FRENCH_DROP)}
                 and not {_in("z", P.OUT_OF_INVENTORY)} then z end as phoneme from d""",
)
def q_normalize_french_reference(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.french_rules("reference"))


def _sampa_sql(table: Mapping[str, str]) -> str:
    return (
        _RAW
        + f""", {_table("m", table)}, {_table("ex", P.SAMPA_TO_IPA)}, {_table("canon", P.NASAL_CANONICAL)},
    a as (select utt, pos, label,
                 replace(replace(replace(replace(replace(nfc_normalize(label), ' ', ''), '@t', 'ə'), '?', ''),
                                 '@', 'ə'), '<p:>', '') as x from raw_labels),
    b as (select *, {_head("x", "ex")} as y from a),
    c as (select b.*, coalesce(m.v, y) as y1 from b left join m on m.k = y),
    d as (select c.*, replace(coalesce(canon.v, y1), 'ː', '') as z from c left join canon on canon.k = y1)
    select utt, pos::bigint as pos,
           case when not {_in("label", P.SAMPA_DROPPED)} and not {_in("z", P.OUT_OF_INVENTORY)} and z <> ''
                then z end as phoneme from d"""
    )


@query("q_normalize_ref_preset", _sampa_sql(P.SAMPA_TO_IPA))
def q_normalize_ref_preset(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.PRESETS["french-sampa"])


@query("q_normalize_broad_preset", _sampa_sql(P.NARROW_TO_BROAD))
def q_normalize_broad_preset(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.PRESETS["french-broad"])


def _asr(name: str = "asr") -> str:
    first = _all("nfc_normalize(label)", (r"\[\[.*?\]\]", r"\[\[|\]\]", r"\(.*?\)", r"\bNONCORR\b"))
    flat = f"trim(regexp_replace({first}, '\\s+', ' ', 'g'))"
    spelled = f"replace(replace({flat}, 'yu', 'uy'), 'nn+yy', 'nn')"
    last = _all(
        "replace(replace(case when contains(x, 'NB sur tDeb') then 'ei' else x end, '#a', 'a'), 'kk+', 'k')",
        (r"\*.*?\*", r"\[\s*pause\s*\]", r"\b\w*pause\w*\b"),
    )
    return f"""{_table("m", P.ASR_CODE_TO_IPA)},
    a as (select utt, pos, start_s, end_s, {spelled} as x from raw_labels),
    b as (select utt, pos, start_s, end_s, {last} as y from a),
    c as (select b.*, replace(coalesce(m.v, y), 'dʒ', 'ʒ') as z from b left join m on m.k = y),
    {name} as (select utt, pos, start_s, end_s,
               case when not {_in("y", P.ASR_CODE_DROPPED)} and z <> '' then z end as phoneme from c)"""


@query("q_normalize_asr_preset", _RAW + "," + _asr() + " select utt, pos::bigint as pos, phoneme from asr")
def q_normalize_asr_preset(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.PRESETS["french-asr-codes"])


@query(
    "q_clean_intervals",
    _RAW
    + f""",
    n as (select utt, pos, {identity("label")} as phoneme, start_s, end_s from raw_labels)
    select utt, row_number() over (partition by utt order by pos) - 1 as pos, phoneme, start_s, end_s
    from n where phoneme is not null""",
)
def q_clean_intervals(spark, sf_dir):
    out = ops.clean_intervals(fx.raw_labels(spark, sf_dir), rules.PRESETS["none"])
    return out.select("utt", "pos", "phoneme", "start_s", "end_s")


@query(
    "q_normalize_sequence",
    f"""
    with t as (select conv_id, turn, unnest(a) as label, unnest(range(0, len(a))) as k
          from (select conv_id, turn, regexp_split_to_array(trim(text, ' ' || chr(10)), '\\s+') as a from conversations)),
    n as (select conv_id, turn, k, {identity("label")} as phoneme from t)
    select conv_id, turn, coalesce(string_agg(phoneme, ' ' order by k) filter (where phoneme is not null), '') as phonemes
    from n group by conv_id, turn""",
)
def q_normalize_sequence(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations").withColumn("c", text.compose("text"))
    seq = ops.normalize_sequence(F.col("text"), F.col("c"), rules.PRESETS["none"])
    return c.select("conv_id", "turn", seq.alias("phonemes"))


@query(
    "q_user_mapping",
    _RAW
    + f""",
    m as (select * from (values ('the', 'DH'), ('of', 'V'), ('and', '')) t(k, v)),
    n as (select utt, pos, {identity("label")} as x from raw_labels),
    j as (select n.*, coalesce(m.v, x) as y from n left join m on m.k = x)
    select utt, pos::bigint as pos, case when not {_dropped("y", P.NON_SPEECH_LABELS)} then y end as phoneme from j""",
)
def q_user_mapping(spark, sf_dir):
    return _normalized(spark, sf_dir, rules.build_rules("none", {"the": "DH", "of": "V", "and": ""}))


# What the French rules make of each code (None: dropped). Kept apart from the preset tables and drop
# sets, which this query tests.
_EXPECTED = {
    "french-asr-codes": "aa a bb b kk k dd d jj ʒ ei e ff f ii i yy j ll l mm m nn n au o pp p ss s tt t ch ʃ ou u vv v ww w "
    "uu y zz z eu ø oe œ an ɑ̃ oo ɔ on ɔ̃ ee ə ai ɛ in ɛ̃ un ɛ̃ gn ɲ gg ɡ uy ɥ rr ʁ r ʁ SIL _ "
    "_ None sil None spn None % None ? None ?? None 0 None # None = None euh None #erreur# None",
    "french-sampa": "Z ʒ A a S ʃ R ʁ r ʁ N ŋ J ɲ H ɥ g ɡ Z= ʒ E ɛ O ɔ 2 ø 9 œ @ ə @t ə a~ ɑ̃ o~ ɔ̃ e~ ɛ̃ 9~ ɛ̃ m= m n= n "
    "ã ɑ̃ ẽ ɛ̃ ĩ ɛ̃ ỹ ɛ̃ œ̃ ɛ̃ ə̃ ɛ̃ ø̃ ɛ̃ "
    "β None θ None ɹ None ɾ None ɣ None ʌ None ʊ None ɪ None ɨ None ɨ̃ None ɜ None ɒ None õ None ũ None "
    "_ None sil None SIL None spn None % None ? None 0 None = None fe~ None Ra~ None sjo~ None ~e None",
    "french-broad": "ɪ i ʊ u ɨ i ɜ ə ʌ ɔ ɒ ɔ ɑ a ɣ ʁ ɹ ʁ ɾ ʁ ʎ l β b θ t c k mʲ m ɟ ɲ ñ ɲ ṽ v "
    "ã ɑ̃ ẽ ɛ̃ ĩ ɛ̃ ỹ ɛ̃ œ̃ ɛ̃ ə̃ ɛ̃ ø̃ ɛ̃ õ None ũ None ɨ̃ None "
    "_ None sil None SIL None spn None % None ? None 0 None = None fe~ None Ra~ None sjo~ None ~e None",
}
_CODES = [
    (p, k, code, None if phoneme == "None" else phoneme)
    for p, t in _EXPECTED.items()
    for k, (code, phoneme) in enumerate(zip(t.split()[::2], t.split()[1::2]))
]


def _code_rows() -> str:
    return ", ".join(f"('{p}', {k}, '{c}', {'NULL' if v is None else repr(v)})" for p, k, c, v in _CODES)


@query(
    "q_preset_coverage",
    _RAW
    + f""",
    m as (select * from (values {_code_rows()}) t(preset, k, code, phoneme)),
    sizes as (select preset, count(*) as size from m group by preset)
    select preset, code, phoneme, count(*) as n
    from raw_labels cross join sizes join m using (preset) where m.k = raw_labels.pos % size group by 1, 2, 3""",
)
def q_preset_coverage(spark, sf_dir):
    # Every token of the conversations stands for one code of a preset, by its position.
    rows = fx.raw_labels(spark, sf_dir)
    out = []
    for preset in _EXPECTED:
        codes = F.array(*(F.lit(c) for p, _, c, _ in _CODES if p == preset))
        coded = rows.select(F.get(codes, F.pmod("pos", F.size(codes)).cast("int")).alias("label"))
        done = ops.normalized(coded, "label", rules.build_rules(preset))
        out.append(done.groupBy(F.col("label").alias("code"), "phoneme").agg(F.count("*").alias("n")).select(F.lit(preset).alias("preset"), "code", "phoneme", "n"))
    return reduce(DataFrame.unionByName, out)
