"""Report writers: metrics, per-label table, label strings, detection timelines, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmark.operators.metrics import STATS, report_headers


def write_metrics(report: DataFrame, path: str, tags: list[str]) -> None:
    """File rows, then style rows, then the overall row, under the report's own headers."""
    rank = F.when(F.col("level") == "file", 0).when(F.col("level") == "style", 1).otherwise(2)
    headers = report_headers(tags)
    report.orderBy(rank, "group").select(
        *[F.col(c).alias(h) for c, h in headers.items()]
    ).write.mode("overwrite").option("header", True).csv(path)


def write_per_phoneme(table: DataFrame, path: str) -> None:
    headers = report_headers([])
    table.orderBy(F.desc_nulls_last("aas_ms")).select(
        "phoneme", *[F.col(c).alias(headers[c]) for c in STATS]
    ).write.mode("overwrite").option("header", True).csv(path)


def write_phoneme_strings(strings: DataFrame, path: str) -> None:
    """filename, phonemes: one line per recording in order."""
    strings.orderBy("utt").select(F.col("utt").alias("filename"), "phonemes").write.mode("overwrite").option(
        "header", True
    ).csv(path)


def etf_lines(rows: DataFrame) -> DataFrame:
    """ETF text lines, ordered by recording, label and time."""
    # The line format.
    line = F.format_string(
        "%s 1 %.6f %.6f sc - %s - %s", "utt", "start_s", "duration_s", "target", "decision"
    )
    return rows.select("utt", "target", "start_s", line.alias("value"))


def write_etf(rows: DataFrame, path: str) -> None:
    """Lines range-partitioned and sorted, so that the part files in order form one timeline file."""
    lines = etf_lines(rows)
    lines.repartitionByRange("utt", "target", "start_s").sortWithinPartitions(
        "utt", "target", "start_s"
    ).select("value").write.mode("overwrite").text(path)


def inventory_lines(inventory: DataFrame) -> DataFrame:
    """The inventory comparison as text lines (line_no, value); inventories are label-set sized."""

    def listed(keep) -> F.Column:
        return F.array_sort(F.collect_list(F.when(keep, F.col("phoneme"))))

    sets = inventory.agg(
        listed(F.col("in_ref")).alias("ref"),
        listed(F.col("in_hyp")).alias("hyp"),
        listed(F.col("in_ref") & F.col("in_hyp")).alias("both"),
        listed(F.col("in_ref") & ~F.col("in_hyp")).alias("only_ref"),
        listed(~F.col("in_ref") & F.col("in_hyp")).alias("only_hyp"),
    )

    def size(label: str, column: str):
        return F.array(F.concat(F.lit(label), F.size(column).cast("string"), F.lit(" symbols")))

    def joined(head: str, column: str):
        return F.concat(F.lit(head), F.array_join(column, " "))

    def only(title: str, column: str):
        shown = F.array(F.lit(""), F.lit(title), joined("  ", column))
        return F.when(F.size(column) > 0, shown).otherwise(F.array().cast("array<string>"))

    # The wording of the report.
    same = (F.size("only_ref") == 0) & (F.size("only_hyp") == 0)
    lines = F.concat(
        size("Reference inventory: ", "ref"),
        size("Hypothesis inventory: ", "hyp"),
        size("Shared: ", "both"),
        F.array(F.lit("")),
        F.array(F.when(same, "Inventories are identical.").otherwise("Inventories differ.")),
        only("Only in REFERENCE:", "only_ref"),
        only("Only in HYPOTHESIS:", "only_hyp"),
        F.array(F.lit(""), joined("REFERENCE:  ", "ref"), joined("HYPOTHESIS: ", "hyp")),
    )
    return sets.select(F.posexplode(lines).alias("line_no", "value"))


def write_inventory(inventory: DataFrame, path: str) -> None:
    inventory_lines(inventory).orderBy("line_no").coalesce(1).select("value").write.mode("overwrite").text(path)
