"""Evaluation inputs derived from the driver's tables, once as DataFrames and once as SQL.

Every view reads whole tables; rules only rename, shift or relabel rows (a hypothesis that misses
or renames labels is what the engine scores). Times are integer milliseconds divided by 1000 so that
every engine sees the same doubles. ``SQL`` holds the same rules as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.operators.scan import longest_key, with_rank, with_row_index
from segmark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LONGEST: dict[tuple[str, str, str], int] = {}


def longest(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """Rows of the busiest key of a table: one counting job per data set, reused by every view."""
    known = (sf_dir, name, key)
    if known not in _LONGEST:
        _LONGEST[known] = longest_key(table(spark, sf_dir, name), key)
    return _LONGEST[known]


def ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a dense rank per user."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("utt"), "event_id", "ts", "user_id", "event_type", "value"
    )
    return with_rank(events, ["utt"], ["ts", "event_id"], longest(spark, sf_dir, "events", "user_id"), "rn").select(
        "*",
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("style"),
        ((F.col("rn") + 1) * 80 + (F.col("event_id") * 37) % 30).alias("start_ms"),
    )


def longest_side(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound on the intervals of one side of one recording in :func:`two_sided`."""
    return 2 * longest(spark, sf_dir, "events", "user_id")


def _seconds(ms: Column) -> Column:
    return ms.cast("double") / 1000


def two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis intervals of every user, long form.

    Columns utt, file, style, side, ord, phoneme, start_s, end_s; ``ord`` grows along a recording.
    """
    late = "IF(value >= 230, 200, 0)"
    base_end = "start_ms + 40 + event_id % 10"

    def row(side: str, sub: int, phoneme: str, start_ms: str, end_ms: str) -> str:
        return (
            f"named_struct('side', '{side}', 'ord', rn * 2 + {sub}, 'phoneme', {phoneme},"
            f" 'start_s', CAST({start_ms} AS DOUBLE) / 1000, 'end_s', CAST({end_ms} AS DOUBLE) / 1000)"
        )

    heard = row(
        "hyp",
        0,
        "IF(value BETWEEN 20 AND 24, 'view', event_type)",
        f"start_ms + (event_id * 53) % 61 - 30 + {late}",
        f"{base_end} + (event_id * 29) % 41 - 20 + {late}",
    )
    added = row("hyp", 1, "'click'", "start_ms + 60", "start_ms + 70")
    rows = f"""filter(array({row("ref", 0, "event_type", "start_ms", base_end)},
                            IF(value >= 5, {heard}, NULL),
                            IF(value BETWEEN 40 AND 43, {added}, NULL)), r -> r IS NOT NULL)"""
    return ranked_events(spark, sf_dir).selectExpr("utt", "concat(utt, '.wav') AS file", "style", f"inline({rows})")


def one_side(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One side with its dense position ``pos`` (zero-based)."""
    rows = two_sided(spark, sf_dir).filter(F.col("side") == side)
    return with_rank(rows, ["utt"], ["ord"], longest_side(spark, sf_dir), "pos").drop("ord", "side")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording lengths; every third recording is shorter than its annotation."""
    e = ranked_events(spark, sf_dir)
    last = e.groupBy("user_id", "utt").agg(
        F.max_by(F.col("start_ms") + 40 + F.col("event_id") % 10, "rn").alias("end_ms")
    )
    return last.select(
        "utt",
        _seconds(F.col("end_ms") + F.when(F.col("user_id") % 3 == 0, -1000).otherwise(200)).alias("duration_s"),
    )


def frames(spark: SparkSession, sf_dir: str, frames_per_chunk: int = 25) -> DataFrame:
    """Frame posteriors from whole embeddings: eight classes, each the maximum of eight entries."""
    e = table(spark, sf_dir, "embeddings")
    ranked = with_rank(e, ["label"], ["vec_id"], longest(spark, sf_dir, "embeddings", "label"), "rn")
    classes = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda k: F.array_max(F.slice("embedding", k * 8 + 1, 8))
    )
    return ranked.select(
        F.concat(F.lit("v"), "label").alias("utt"),
        F.floor(F.col("rn") / frames_per_chunk).cast("int").alias("chunk"),
        (F.col("rn") % frames_per_chunk).cast("int").alias("frame"),
        classes.alias("logits"),
    )


def frame_vocab(spark: SparkSession) -> DataFrame:
    """Vocabulary of the eight frame classes."""
    # Fixed values.
    rows = [(0, "[PAD]"), (1, "a"), (2, "i"), (3, "s"), (4, "̃"), (5, "[UNK]"), (6, "|"), (7, "ʁ")]
    return spark.createDataFrame(rows, "id int, token string")


def vad_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity scores, one frame per event."""
    return ranked_events(spark, sf_dir).select(
        "utt",
        F.col("rn").cast("int").alias("frame"),
        ((F.col("rn") + 1).cast("double") / 10).alias("t"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("score"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing (side, path) shaped like a corpus with twins, copies and hidden files."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    stem = F.concat(F.col("lang"), F.col("doc_id").cast("string"))
    n = F.col("n_chars")

    def path(side, folder, name):
        return F.struct(F.lit(side).alias("side"), F.concat(F.lit(f"{side}/"), folder, F.lit("/"), name).alias("path"))

    src = F.col("source")
    paths = F.array(
        F.when(n >= 500, path("audio", src, F.concat(stem, F.when(n > 2000, F.lit(".WAV")).otherwise(F.lit(".flac"))))),
        path("ref", src, F.concat(stem, F.lit(".TextGrid"))),
        F.when(n > 1000, path("ref", F.concat(src, F.lit("-b")), F.concat(stem, F.lit("-ref.TextGrid")))),
        F.when(n > 3000, path("ref", F.concat(src, F.lit("/z")), F.concat(stem, F.lit("-ref.textgrid")))),
        F.when(n < 400, path("ref", src, F.concat(F.lit("."), stem, F.lit("x.TextGrid")))),
        F.when(n < 5000, path("hyp", src, F.concat(stem, F.lit(".TextGrid")))),
        F.when(n < 300, path("hyp", F.lit(".ipynb_checkpoints"), F.concat(stem, F.lit("c.TextGrid")))),
        F.when(n < 900, path("hyp", F.concat(src, F.lit("-b")), F.concat(stem, F.lit(".TextGrid")))),
        path("audio", src, F.concat(stem, F.lit(".txt"))),
    )
    return d.select(F.inline(F.filter(paths, lambda p: p.isNotNull())))


def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group metadata lines keyed on stem or audio name, with blanks, repeats and gaps."""
    e = ranked_events(spark, sf_dir)
    u = e.groupBy("user_id", "utt", "style").agg(F.count("*").alias("n"))
    key = F.when(F.col("user_id") % 2 == 0, F.col("utt")).otherwise(F.concat("utt", F.lit(".wav")))

    def line(sub, file, style):
        return F.struct(
            (F.col("user_id") * 4 + sub).alias("line_no"), file.alias("file"), style.alias("style")
        )

    lines = F.array(
        F.when(F.col("n") >= 55, line(0, F.concat(F.lit(" "), key, F.lit(" ")), F.col("style"))),
        F.when(F.col("n") >= 70, line(1, key, F.lit("late"))),
        F.when(F.col("n") >= 75, line(2, key, F.lit(" "))),
        line(3, F.lit("  "), F.col("style")),
    )
    return u.select(F.inline(F.filter(lines, lambda r: r.isNotNull())))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every conversation as a raw annotation label, some wrapped in markup."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    tokens = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[ \n]+")).alias("k", "token"))
    k, t = F.col("k"), F.col("token")
    label = (
        F.when(k % 11 == 1, F.concat(F.lit("["), t, F.lit("]")))
        .when(k % 11 == 2, F.concat(F.lit("[["), t, F.lit("]] "), t))
        .when(k % 11 == 3, F.concat(t, F.lit(" ("), t, F.lit(")")))
        .when(k % 11 == 4, F.concat(F.lit("*"), t, F.lit("*"), t))
        .when(k % 11 == 5, F.concat(t, F.lit(" xpausex")))
        .when(k % 11 == 6, F.concat(t, F.lit("\nnote "), t))
        .when(k % 11 == 7, F.concat(F.lit(" "), t, F.lit(" ~ "), t))
        .otherwise(t)
    )
    return tokens.select(
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("utt"),
        k.alias("pos"),
        label.alias("label"),
        (k.cast("double") / 10).alias("start_s"),
        ((k.cast("double") + 1) / 10).alias("end_s"),
    )


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: one per conversation turn, in file order."""
    c = table(spark, sf_dir, "conversations")
    ranked = with_row_index(
        c, [], ["conv_id", "turn"], F.floor(F.col("conv_id") / 1024).cast("long"), "row_idx", write=False
    )
    return ranked.select(
        "row_idx",
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav")).alias("path"),
        F.col("text").alias("phonemes"),
        (F.length("text") * 400).cast("int").alias("input_length"),
    )


#: The same views for the oracle, as common table expressions; ``with_views`` picks what a query needs.
SQL: dict[str, str] = {
    "ev": """
        select *, 'u' || user_id as utt, 'g' || (user_id % 4) as style,
               (rn + 1) * 80 + (event_id * 37) % 30 as start_ms
        from (select event_id, user_id, event_type, value,
                     row_number() over (partition by user_id order by ts, event_id) - 1 as rn
              from events)""",
    "ref_iv": """
        select utt, utt || '.wav' as file, style, rn as pos, event_type as phoneme,
               start_ms::double / 1000 as start_s, (start_ms + 40 + event_id % 10)::double / 1000 as end_s
        from ev""",
    "hyp_raw": """
        select utt, style, rn * 2 as ord,
               case when value between 20 and 24 then 'view' else event_type end as phoneme,
               start_ms + (event_id * 53) % 61 - 30 + case when value >= 230 then 200 else 0 end as s,
               start_ms + 40 + event_id % 10 + (event_id * 29) % 41 - 20
                 + case when value >= 230 then 200 else 0 end as e
        from ev where value >= 5
        union all
        select utt, style, rn * 2 + 1, 'click', start_ms + 60, start_ms + 70
        from ev where value between 40 and 43""",
    "hyp_iv": """
        select utt, utt || '.wav' as file, style,
               row_number() over (partition by utt order by ord) - 1 as pos, phoneme,
               s::double / 1000 as start_s, e::double / 1000 as end_s
        from hyp_raw""",
    "durations": """
        select utt, (end_ms + case when user_id % 3 = 0 then -1000 else 200 end)::double / 1000 as duration_s
        from (select user_id, utt, max_by(start_ms + 40 + event_id % 10, rn) as end_ms from ev group by 1, 2)""",
    "frames": """
        select 'v' || label as utt, (rn // 25)::int as chunk, (rn % 25)::int as frame,
               list_transform(range(0, 8), lambda k: list_max(embedding[(k * 8 + 1):(k * 8 + 8)])) as logits
        from (select *, row_number() over (partition by label order by vec_id) - 1 as rn from embeddings)""",
    "frame_vocab": """
        select * from (values (0, '[PAD]'), (1, 'a'), (2, 'i'), (3, 's'), (4, chr(771)), (5, '[UNK]'),
                              (6, '|'), (7, chr(641))) v(id, token)""",
    "vad": """
        select utt, rn::int as frame, (rn + 1)::double / 10 as t,
               ((event_id * 7919) % 1000)::double / 1000 as score
        from ev""",
    "listing": """
        with d as (select lang || doc_id as stem, source as src, n_chars as n from documents)
        select 'audio' as side, 'audio/' || src || '/' || stem || case when n > 2000 then '.WAV' else '.flac' end as path from d where n >= 500
        union all select 'ref', 'ref/' || src || '/' || stem || '.TextGrid' from d
        union all select 'ref', 'ref/' || src || '-b/' || stem || '-ref.TextGrid' from d where n > 1000
        union all select 'ref', 'ref/' || src || '/z/' || stem || '-ref.textgrid' from d where n > 3000
        union all select 'ref', 'ref/' || src || '/.' || stem || 'x.TextGrid' from d where n < 400
        union all select 'hyp', 'hyp/' || src || '/' || stem || '.TextGrid' from d where n < 5000
        union all select 'hyp', 'hyp/.ipynb_checkpoints/' || stem || 'c.TextGrid' from d where n < 300
        union all select 'hyp', 'hyp/' || src || '-b/' || stem || '.TextGrid' from d where n < 900
        union all select 'audio', 'audio/' || src || '/' || stem || '.txt' from d""",
    "group_rows": """
        with u as (select user_id, utt, style, count(*) as n,
                          case when user_id % 2 = 0 then utt else utt || '.wav' end as key
                   from ev group by user_id, utt, style)
        select user_id * 4 as line_no, ' ' || key || ' ' as file, style from u where n >= 55
        union all select user_id * 4 + 1, key, 'late' from u where n >= 70
        union all select user_id * 4 + 2, key, ' ' from u where n >= 75
        union all select user_id * 4 + 3, '  ', style from u""",
    "raw_labels": """
        select 'c' || conv_id || '_' || turn as utt, k as pos,
               case k % 11 when 1 then '[' || t || ']'
                           when 2 then '[[' || t || ']] ' || t
                           when 3 then t || ' (' || t || ')'
                           when 4 then '*' || t || '*' || t
                           when 5 then t || ' xpausex'
                           when 6 then t || chr(10) || 'note ' || t
                           when 7 then ' ' || t || ' ~ ' || t
                           else t end as label,
               k::double / 10 as start_s, (k::double + 1) / 10 as end_s
        from (select conv_id, turn, unnest(a) as t, unnest(range(0, len(a))) as k
              from (select conv_id, turn, regexp_split_to_array(text, '[ \\n]+') as a from conversations))""",
    "training": """
        select row_number() over (order by conv_id, turn) - 1 as row_idx,
               conv_id || '_' || turn || '.wav' as path, text as phonemes,
               (length(text) * 400)::int as input_length
        from conversations""",
}

_NEEDS = {
    "ref_iv": ["ev"],
    "hyp_raw": ["ev"],
    "hyp_iv": ["hyp_raw"],
    "durations": ["ev"],
    "vad": ["ev"],
    "group_rows": ["ev"],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause (without a trailing comma) holding the named views and what they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({SQL[n]})" for n in done)
