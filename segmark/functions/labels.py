"""Label normalisation rules as column expressions.

A rule set turns a raw annotation label into a comparable label, or NULL when the label is not
scorable. Everything is built-in functions except Unicode composition (:func:`text.compose`), which
runs once ahead of the chain.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmark.functions import presets as P
from segmark.functions import text
from segmark.functions.guarded import guarded

GENERAL, SAMPA, ASR_CODES = "general", "sampa", "asr_codes"


@dataclass(frozen=True)
class LabelRules:
    """A declarative rule set. ``family`` picks the chain; the tables may be replaced freely."""

    family: str = GENERAL
    mapping: Mapping[str, str] = field(default_factory=dict)
    canonical: Mapping[str, str] = field(default_factory=dict)
    silence: Sequence[str] = P.SILENCE_LABELS
    drop_labels: Sequence[str] = P.NON_SPEECH_LABELS
    drop_phonemes: Sequence[str] = ()
    strip_markup: bool = True
    strip_length_marks: bool = True
    truncate_clusters: bool = False
    truncation_exempt: Mapping[str, str] | None = None
    vowels: str = P.VOWELS

    def with_mapping(self, mapping: Mapping[str, str]) -> LabelRules:
        """Same rules with the exact-match table replaced."""
        return replace(self, mapping=dict(mapping))

    def expression(self, raw: Column, nfc: Column, marks: Column) -> Column:
        """Normalised label from the raw label, its composed form and its combining marks."""
        chain = {GENERAL: _general, SAMPA: _sampa, ASR_CODES: _asr_codes}[self.family]
        return F.when(raw.isNotNull(), chain(self, raw, nfc, marks))


@dataclass(frozen=True)
class CustomRules:
    """Any label function in place of a rule set: takes the raw label column, gives the label or NULL.

    A vectorised Python function works too; it then runs over the distinct labels only. In a run (``outcome``), a label
    on which a Python function raises has no result and a reason.
    """

    function: Callable[[Column], Column]

    def expression(self, raw: Column, nfc: Column, marks: Column) -> Column:
        return self.function(raw)

    def outcome(self, raw: Column) -> Column:
        """(value, error) of the label; none of an absent one."""
        return F.when(raw.isNotNull(), guarded(self.function, distinct=True)(raw))


def french_rules(kind: str = "reference") -> LabelRules:
    """The general chain set up for French: SAMPA references, ASR codes, or a model's narrow IPA."""
    table = {"reference": P.SAMPA_TO_IPA, "asr_codes": P.ASR_CODE_TO_IPA, "hypothesis": P.NARROW_TO_BROAD}
    if kind not in table:
        raise ValueError(f"kind must be one of {sorted(table)}, got {kind!r}")
    return LabelRules(
        mapping=table[kind],
        canonical=P.NASAL_CANONICAL,
        drop_labels=(*P.NON_SPEECH_LABELS, *P.FILLER_LABELS),
        drop_phonemes=P.OUT_OF_INVENTORY,
        truncate_clusters=kind == "reference",
    )


#: Rule sets by preset name.
PRESETS: dict[str, LabelRules] = {
    "none": LabelRules(),
    "french-sampa": LabelRules(SAMPA, mapping=P.SAMPA_TO_IPA),
    "french-asr-codes": LabelRules(ASR_CODES, mapping=P.ASR_CODE_TO_IPA),
    # Truncation is tested against the SAMPA table on this side too.
    "french-broad": LabelRules(SAMPA, mapping=P.NARROW_TO_BROAD, truncation_exempt=P.SAMPA_TO_IPA),
}


def build_rules(preset: str, mapping: Mapping[str, str] | None = None) -> LabelRules:
    """A preset, optionally with its exact-match table replaced."""
    rules = PRESETS[preset]
    return rules if mapping is None else rules.with_mapping(mapping)


#: A character of a word: letters, numbers and the underscore, combining marks not.
WORD = r"[\p{L}\p{N}_]"


def strip_annotation_markup(c: Column) -> Column:
    """Remove trailing lines, bracketed and starred remarks, and pause words; collapse blanks.

    Most labels hold none of these: a search tells before anything is replaced.
    """
    def replaced(x: Column, sign: str, *patterns: str) -> Column:
        out = x
        for pattern in patterns:
            out = F.regexp_replace(out, pattern, "")
        return F.when(x.rlike(sign), out).otherwise(x)

    # The patterns, in this order.
    remarks = (r"(?s)\n.*", r"(?s)\[\[.*?\]\]", r"(?s)\[.*?\]", r"\[\[|\]\]|\[|\]", r"(?s)\(.*?\)", r"(?s)\*.*?\*")
    pause = rf"(?iu)(?<!{WORD}){WORD}*pause{WORD}*(?!{WORD})"
    blank = rf"(?U){text.BLANK}"
    c = text.let(replaced(c, r"[\n\[\](*]", *remarks), lambda x: replaced(x, "(?iu)pause", pause))
    return text.let(c, lambda x: F.when(x.rlike(blank), text.strip(F.regexp_replace(x, f"{blank}+", " "))).otherwise(x))


def _lookup(table: Mapping[str, str], c: Column) -> Column:
    if not table:
        return c
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return text.let(c, lambda x: F.coalesce(F.try_element_at(pairs, x), x))


def _among(c: Column, labels: Sequence[str]) -> Column:
    return c.isin(*labels) if labels else F.lit(False)


def _dropped(rules: LabelRules, c: Column) -> Column:
    low = F.lower(c)
    return (c == "") | _among(c, rules.drop_labels) | _among(low, rules.drop_labels) | _among(low, rules.silence)


def _first_if_cluster(c: Column, exempt: Mapping[str, str], vowels: str) -> Column:
    def body(x: Column) -> Column:
        head = F.substring(x, 1, 1)
        cluster = (F.length(x) > 1) & ~_among(x, list(exempt)) & (F.instr(F.lit(vowels), head) == 0)
        return F.when(cluster, head).otherwise(x)

    return text.let(c, body)


def _one_tilde(c: Column) -> Column:
    return F.regexp_replace(c, f"{P.COMBINING_TILDE}+", P.COMBINING_TILDE)


def _without(c: Column, part: str) -> Column:
    return F.replace(c, F.lit(part), F.lit(""))


def _general(rules: LabelRules, raw: Column, nfc: Column, marks: Column) -> Column:
    def spell(label: Column) -> Column:
        out = _one_tilde(label)
        if rules.truncate_clusters:
            out = _first_if_cluster(out, rules.mapping, rules.vowels)
        out = _lookup(rules.canonical, _lookup(rules.mapping, out))
        return _without(out, P.LENGTH_MARK) if rules.strip_length_marks else out

    def judge(label: Column) -> Column:
        gone = _dropped(rules, label) | text.only_marks(label, marks)
        kept = text.let(
            spell(label), lambda out: F.when(~_among(out, rules.drop_phonemes) & ~_dropped(rules, out), out)
        )
        return F.when(~gone, kept)

    return text.let(_without(strip_annotation_markup(nfc) if rules.strip_markup else nfc, " "), judge)


def _sampa(rules: LabelRules, raw: Column, nfc: Column, marks: Column) -> Column:
    out = _without(nfc, " ")
    # In-label rewrites, in this order.
    for old, new in (("@t", "ə"), ("?", ""), ("@", "ə"), ("<p:>", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    exempt = rules.mapping if rules.truncation_exempt is None else rules.truncation_exempt
    out = _first_if_cluster(_one_tilde(out), exempt, P.VOWELS)
    out = _without(_lookup(P.NASAL_CANONICAL, _lookup(rules.mapping, out)), P.LENGTH_MARK)
    gone = _among(raw, P.SAMPA_DROPPED) | text.only_marks(nfc, marks)
    kept = text.let(out, lambda x: F.when(~_among(x, P.OUT_OF_INVENTORY) & (x != ""), x))
    return F.when(~gone, kept)


def _asr_codes(rules: LabelRules, raw: Column, nfc: Column, marks: Column) -> Column:
    out = nfc
    # Patterns and spellings, in this order.
    for pattern in (r"(?d)\[\[.*?\]\]", r"\[\[|\]\]", r"(?d)\(.*?\)", rf"(?<!{WORD})NONCORR(?!{WORD})"):
        out = F.regexp_replace(out, pattern, "")
    out = text.strip(F.regexp_replace(out, rf"(?U){text.BLANK}+", " "))
    for old, new in (("yu", "uy"), ("nn+yy", "nn")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = text.let(out, lambda x: F.when(F.contains(x, F.lit("NB sur tDeb")), "ei").otherwise(x))
    for old, new in (("#a", "a"), ("kk+", "k")):
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern in (r"(?d)\*.*?\*", rf"(?U)\[{text.BLANK}*pause{text.BLANK}*\]", rf"(?<!{WORD}){WORD}*pause{WORD}*(?!{WORD})"):
        out = F.regexp_replace(out, pattern, "")

    def judge(x: Column) -> Column:
        gone = _among(x, P.ASR_CODE_DROPPED) | text.only_marks(x, marks)
        mapped = F.replace(_lookup(rules.mapping, x), F.lit("dʒ"), F.lit("ʒ"))
        return F.when(~gone & (mapped != ""), mapped)

    return text.let(out, judge)
