"""Annotation text (long or short TextGrid form) to tiers and intervals.

Both forms carry the same stream of free-standing numbers and quoted strings; everything else is
decoration. A file becomes its token stream, tiers are found by walking the counts in it, and the
intervals of the chosen tier are unfolded. All built-in functions, one row per file until the unfolding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmark.functions import presets, text
from segmark.session import cut, small_batches, spread
from segmark.sources import stores

# Tier names tried in this order, token pattern.
DEFAULT_TIER_NAMES = ("phones", "phonemes", "phone", "phon", "segments")
_TOKEN = r'"(?:[^"]|"")*"|(?<=^|\s)[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=\s|$)'


@dataclass(frozen=True)
class TierChoice:
    """Which tier to read: exact name, else first name containing a text, else position, else the usual names."""

    tier: str | None = None
    contains: str | None = None
    index: int | None = None
    rename_duplicates: bool = True


def text_of(body: bytes) -> str:
    if body[:2] in (b"\xfe\xff", b"\xff\xfe") and len(body) % 2 == 0:
        return body.decode("utf-16")
    return body.decode("utf-8-sig")


def read_paths(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` and ``error``: annotation files by ``path``, read in tasks.

    UTF-8, or UTF-16 with a byte-order mark. Only the files of the table are opened.
    """
    at = files.columns.index("path")

    def read(batches):
        for pdf in batches:
            contents, errors = [], []
            for path in pdf.iloc[:, at]:
                content = error = None
                try:
                    content = text_of(stores.read_bytes(path))
                except UnicodeDecodeError:
                    error = "ValueError: neither UTF-8 nor UTF-16 text"
                except Exception as exc:  # one unreadable file must not end the job
                    error = f"{type(exc).__name__}: {exc}"
                contents.append(content)
                errors.append(error)
            yield pdf.assign(content=contents, error=errors)

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])
    return spread(files).mapInPandas(read, schema)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All annotation files under a folder as (path, content, error)."""
    return read_paths(stores.list_paths(spark, folder))


def choose_tier(names: Column, choice: TierChoice) -> tuple[Column, Column]:
    """(one-based position of the chosen tier or NULL, error or NULL) for an array of tier names."""
    count = F.size(names)
    lowered = F.transform(names, F.lower)
    no_tiers = F.when(count == 0, "ValueError: TextGrid has no tiers")
    if choice.tier is not None:
        at = F.array_position(names, choice.tier)
        return F.when(at > 0, at), F.coalesce(
            no_tiers, F.when(at == 0, f"KeyError: tier {choice.tier!r} is missing")
        )
    found = F.lit(None).cast("long")
    error = no_tiers
    if choice.contains is not None:
        hit = F.transform(lowered, lambda n: F.contains(n, F.lit(choice.contains.lower())))
        found = F.nullif(F.array_position(hit, True), F.lit(0).cast("long"))
        if choice.index is None:
            missing = F.when(found.isNull(), f"KeyError: no tier name contains {choice.contains!r}")
            return found, F.coalesce(error, missing)
    if choice.index is not None:
        at = F.lit(choice.index + 1) if choice.index >= 0 else count + choice.index + 1
        inside = (at >= 1) & (at <= count)
        found = F.coalesce(found, F.when(inside, at.cast("long")))
        return found, F.coalesce(error, F.when(found.isNull(), "IndexError: list index out of range"))
    usual = F.lit(None).cast("long")
    for candidate in DEFAULT_TIER_NAMES:
        # Names equal but for case: the last one counts.
        back = F.array_position(F.reverse(lowered), candidate)
        usual = F.coalesce(usual, F.when(back > 0, count - back + 1))
    return F.when(count > 0, F.coalesce(usual, F.lit(1).cast("long"))), error


def _unquoted(c: Column) -> Column:
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.replace(inner, F.lit('""'), F.lit('"'))


def tiers(texts: DataFrame, key: str = "utt", rename_duplicates: bool = True) -> DataFrame:
    """Tier table of every file: names, kinds and where each tier starts in the token stream.

    Columns key, error, tokens, starts, names, kinds. Malformed files carry an error instead.
    """
    tokens = F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))
    head = F.try_element_at("tokens", F.lit(2)) == '"TextGrid"'

    def number(at: Column) -> Column:
        return F.try_element_at("tokens", at).try_cast("int")

    def width(at: Column) -> Column:
        per = F.when(F.try_element_at("tokens", at) == '"IntervalTier"', 3).when(
            F.try_element_at("tokens", at) == '"TextTier"', 2
        )
        return 5 + per * number((at + 4).cast("int"))

    # Tiers start at token 6: type, class, xmin, xmax, tier count come first. The <exists> flag is no token.
    def step(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.array_append(acc, (last + width(last)).cast("int"))

    count = number(F.lit(5))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.coalesce("n_tiers", F.lit(0)), F.lit(1))), F.array(F.lit(6)), step
    )
    given = F.transform("starts", lambda s: _unquoted(F.try_element_at("tokens", s + 1)))

    def renamed(names: str) -> Column:
        def one(n: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda m: m == n))
            return F.when(before > 0, F.concat(n, F.lit("_"), (before + 1).cast("string"))).otherwise(n)

        return F.transform(names, one)

    base = text.pinned(texts, tokens=tokens)
    base = text.pinned(base, n_tiers=F.when(head, count))
    base = text.pinned(base, walk=walked)
    closed = F.coalesce(F.element_at("walk", -1) == F.size("tokens") + 1, F.lit(False))
    base = base.withColumn("ok", F.coalesce((F.col("n_tiers") == 0) | closed, F.lit(False)))
    none = F.array().cast("array<int>")
    base = text.pinned(
        base, starts=F.when(F.col("ok"), F.slice("walk", F.lit(1), F.greatest("n_tiers", F.lit(0)))).otherwise(none)
    )
    base = text.pinned(base, given=given)
    names = renamed("given") if rename_duplicates else F.col("given")
    kinds = F.transform("starts", lambda s: _unquoted(F.try_element_at("tokens", s)))
    return base.select(
        key,
        F.coalesce("error", F.when(~F.col("ok"), "ValueError: not a readable TextGrid")).alias("error"),
        "tokens",
        "starts",
        names.alias("names"),
        kinds.alias("kinds"),
    )


def tier_names(tier_table: DataFrame, key: str = "utt") -> DataFrame:
    """(key, tier_pos, tier_name), positions from 0."""
    return tier_table.select(key, F.posexplode("names").alias("tier_pos", "tier_name"))


def read_intervals(
    tier_table: DataFrame,
    choice: TierChoice = TierChoice(),
    key: str = "utt",
    remove_silence: bool = True,
    silence: Sequence[str] = presets.SILENCE_LABELS,
    write: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(intervals key, pos, label, start_s, end_s; failures key, reason).

    Labels are stripped of outer blanks; blank ones go, and silence too unless kept on purpose. ``write``: what was found
    in each file is written once, for callers that read the intervals several times.
    """
    at, error = choose_tier(F.col("names"), choice)
    points = F.try_element_at("kinds", "at") != "IntervalTier"
    chosen = text.pinned(tier_table, at=at.cast("int"))
    chosen = text.pinned(
        chosen,
        why=F.coalesce("error", error, F.when(points, "ValueError: the chosen tier holds points")),
        start=F.try_element_at("starts", "at"),
    )
    chosen = text.pinned(
        chosen.select(key, F.col("why").alias("error"), "tokens", "start"),
        n=F.try_element_at("tokens", F.col("start") + 4).try_cast("int"),
    )
    def item(k: Column) -> Column:
        at_k = (F.col("start") + 5 + 3 * k).cast("int")
        label = F.try_element_at("tokens", at_k + 2)
        return F.struct(
            k.alias("pos"),
            F.when(F.startswith(label, F.lit('"')), text.strip(_unquoted(label))).alias("label"),
            F.try_element_at("tokens", at_k).try_cast("double").alias("start_s"),
            F.try_element_at("tokens", at_k + 1).try_cast("double").alias("end_s"),
        )

    listed = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), item)
    chosen = text.pinned(chosen, items=F.when(F.col("error").isNull() & (F.col("n") > 0), listed))
    # Counts may fit although the tokens are out of order.
    broken = F.exists("items", lambda i: i["label"].isNull() | i["start_s"].isNull() | i["end_s"].isNull())
    why = F.coalesce("error", F.when(broken, "ValueError: not a readable TextGrid"))
    chosen = text.pinned(chosen.drop("tokens"), why=why)
    if write:
        with small_batches(tier_table.sparkSession):
            chosen = cut(chosen.select(key, "why", F.when(F.col("why").isNull(), F.col("items")).alias("items")), "intervals")
    failures = chosen.filter(F.col("why").isNotNull()).select(key, F.col("why").alias("reason"))
    rows = chosen.filter(F.col("why").isNull()).select(key, F.inline("items")).filter(F.col("label") != "")
    if remove_silence:
        rows = rows.filter(~F.lower("label").isin(*silence))
    return rows, failures


def long_form(intervals: DataFrame, decoy: str = "words", tier: str = "phones") -> DataFrame:
    """Write the intervals of each recording as long-form text with a leading decoy tier."""
    item = F.struct("pos", "start_s", "end_s", "phoneme")
    grouped = intervals.groupBy("utt").agg(
        F.sort_array(F.collect_list(item)).alias("o"), F.max("end_s").alias("xmax")
    )

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    def block(x: Column, i: Column) -> Column:
        return F.concat(
            F.format_string("        intervals [%d]:\n            xmin = ", i + 1),
            x["start_s"].cast("string"),
            F.lit("\n            xmax = "),
            x["end_s"].cast("string"),
            F.lit("\n            text = "),
            quoted(x["phoneme"]),
            F.lit(" \n"),
        )

    xmax = F.col("xmax").cast("string")

    def head(n: int, name: str, size: Column) -> Column:
        return F.concat(
            F.lit(f'    item [{n}]:\n        class = "IntervalTier" \n        name = "{name}" \n        xmin = 0 \n        xmax = '),
            xmax,
            F.lit(" \n        intervals: size = "),
            size.cast("string"),
            F.lit(" \n"),
        )

    content = F.concat(
        F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0 \nxmax = '),
        xmax,
        F.lit(" \ntiers? <exists> \nsize = 2 \nitem []: \n"),
        head(1, decoy, F.lit(1)),
        F.lit("        intervals [1]:\n            xmin = 0 \n            xmax = "),
        xmax,
        F.lit('\n            text = "one ""two"" 3 " \n'),
        head(2, tier, F.size("o")),
        F.array_join(F.transform("o", block), ""),
    )
    return grouped.select("utt", content.alias("content"), F.lit(None).cast("string").alias("error"))
