"""Text coordinates: hashes, verification, containment, segments, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.hot import hot_keys
from lodestrata.operators.stab import around, cover

#: Offsets are below 2^31.
OFFSET_BITS = 31


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def cut_out(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) in code points."""
    return F.substring(text, start + 1, end - start)


def span_code(text: Column, start: Column, end: Column, expected: Column) -> Column:
    """Null where the slice has the expected hash, else OFFSET_MISMATCH or HASH_MISMATCH."""
    outside = (start < 0) | (end <= start) | (end > F.length(text))
    return F.when(outside | text.isNull(), "OFFSET_MISMATCH").when(~content_hash(cut_out(text, start, end)).eqNullSafe(expected), "HASH_MISMATCH")


def running_offsets(lines: DataFrame, doc: str, order: str, text: str, separator: int = 1) -> DataFrame:
    """Adds start_char and end_char of each line in the text its lines make when joined."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0)).cast("bigint")
    return lines.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length(text))


def flat_sections(sections: DataFrame, lengths: DataFrame) -> DataFrame:
    """Flat ranges: a section ends where the next one of its version starts, the last at the text's end.

    ``sections`` has (document_version_id, id, start_char), ``lengths`` (document_version_id, n_chars).
    """
    w = Window.partitionBy("document_version_id").orderBy("start_char", "id")
    return sections.select("document_version_id", "id", "start_char", F.lead("start_char").over(w).alias("__next")).join(lengths, "document_version_id", "left").select("document_version_id", "id", "start_char", F.coalesce("__next", "n_chars").alias("end_char"))


def contained_spans(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(span_id, section_id, code): whether a span lies in its section and in the same version.

    Spans have (id, section_id, document_version_id, start_char, end_char), sections likewise.
    """
    s = sections.select(F.col("id").alias("section_id"), F.col("document_version_id").alias("__v"), F.col("start_char").alias("__s"), F.col("end_char").alias("__e"))
    code = F.when(F.col("__v").isNull(), "unknown_section").when(F.col("__v") != F.col("document_version_id"), "cross_version").when((F.col("start_char") < F.col("__s")) | (F.col("end_char") > F.col("__e")), "outside_section").otherwise("ok")
    return spans.join(s, "section_id", "left").select(F.col("id").alias("span_id"), "section_id", code.alias("code"))


def segments(spans: DataFrame, group: str) -> DataFrame:
    """(group, seg_start, seg_end, covers): a group cut at all span boundaries, with the spans over each segment.

    Covering counts come from a running sum of starts and ends, so spans are not
    joined with each other. Only covered segments are returned; which spans cover one tells :func:`section_segments`.
    """
    s = spans.where("end_char > start_char").select(group, "id", "start_char", "end_char").distinct()
    edges = s.select(group, F.explode(F.array(F.struct(F.col("start_char").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_char").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    edges = edges.groupBy(group, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(group).orderBy("at")
    cut = edges.select(group, F.col("at").alias("seg_start"), F.lead("at").over(w).alias("seg_end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("covers"))
    return cut.where("seg_end is not null and covers > 0")


def spans_over(spans: DataFrame, points: DataFrame, group: str, few: int = 256) -> DataFrame:
    """(group, at, id): every span over each point, once.

    Spans and points, from 0 on, are distinct. A group of up to ``few`` spans meets its points
    directly. In larger ones they meet in aligned intervals: those of a span don't overlap, so a
    point finds it in one of them, and only pairs that are returned are made.
    """
    hot = hot_keys(spans, [group], few)
    small = spans if hot is None else spans.join(hot, group, "left_anti")
    met = small.join(points, group).where((F.col("start_char") <= F.col("at")) & (F.col("at") < F.col("end_char"))).select(group, "at", "id")
    if hot is not None:
        kept = spans.join(hot, group, "left_semi").select(group, "id", F.explode(cover(F.col("start_char"), F.col("end_char"), OFFSET_BITS)).alias("__n"))
        asked = points.join(hot, group, "left_semi").select(group, "at", F.explode(around(F.col("at"), OFFSET_BITS)).alias("__n"))
        met = met.unionByName(asked.join(kept, [group, "__n"]).select(group, "at", "id"))
    return met


def section_segments(spans: DataFrame, sections: DataFrame, few: int = 256) -> DataFrame:
    """(section_id, seg_start, seg_end, span_id): each section cut at all boundaries of its spans, without gaps.

    A row for each span over a segment, one without span_id where there is none. Spans that aren't
    within their section are left out, not clamped. Spans have (id, section_id, start_char, end_char), sections (id,
    start_char, end_char); offsets are those of the text.
    """
    whole = sections.where("start_char >= 0 and end_char > start_char").select(F.col("id").alias("section_id"), F.col("start_char").alias("__s"), F.col("end_char").alias("__e")).distinct()
    inside = spans.join(whole, "section_id").where("start_char >= __s and end_char > start_char and end_char <= __e").select("section_id", "id", "start_char", "end_char").distinct()
    edges = whole.select("section_id", F.explode(F.array("__s", "__e")).alias("at")).unionByName(inside.select("section_id", F.explode(F.array("start_char", "end_char")).alias("at"))).distinct()
    cut = edges.select("section_id", "at", F.lead("at").over(Window.partitionBy("section_id").orderBy("at")).alias("seg_end")).where("seg_end is not null")
    over = spans_over(inside, cut.select("section_id", "at"), "section_id", few)
    return cut.join(over, ["section_id", "at"], "left").select("section_id", F.col("at").alias("seg_start"), "seg_end", F.col("id").alias("span_id"))


def narrowest_spans(spans: DataFrame, points: DataFrame, group: str, few: int = 256) -> DataFrame:
    """(group, at, id): of the spans over each point the shortest, then the smallest id.

    ``points`` has (group, at). A group of up to ``few`` spans meets its points directly. In
    larger ones points and spans meet in aligned intervals of which each keeps its best
    span, so a group with many of both makes no pairs.
    """
    p = points.where(F.col(group).isNotNull() & (F.col("at") >= 0)).select(group, "at").distinct()
    s = spans.where(F.col(group).isNotNull() & (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char"))).select(group, "id", "start_char", "end_char").distinct()
    best = F.struct((F.col("end_char") - F.col("start_char")).alias("n"), "id")
    hot = hot_keys(s, [group], few)
    small = s if hot is None else s.join(hot, group, "left_anti")
    met = small.join(p, group).where((F.col("start_char") <= F.col("at")) & (F.col("at") < F.col("end_char"))).select(group, "at", best.alias("b"))
    if hot is not None:
        kept = s.join(hot, group, "left_semi").select(group, best.alias("b"), F.explode(cover(F.col("start_char"), F.col("end_char"), OFFSET_BITS)).alias("__n")).groupBy(group, "__n").agg(F.min("b").alias("b"))
        asked = p.join(hot, group, "left_semi").select(group, "at", F.explode(around(F.col("at"), OFFSET_BITS)).alias("__n"))
        met = met.unionByName(asked.join(kept, [group, "__n"]).select(group, "at", "b"))
    return met.groupBy(group, "at").agg(F.min("b").alias("b")).select(group, "at", "b.id")


def local_anchor(start: Column, end: Column, section_start: Column, section_end: Column) -> Column:
    """Offsets of a span within its section, null where it isn't inside."""
    inside = (start >= section_start) & (end <= section_end) & (end > start)
    return F.when(inside, F.struct((start - section_start).alias("start"), (end - section_start).alias("end")))
