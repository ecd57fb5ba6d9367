"""Placeholders, masking, highlighting and the way from entities to detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.functions import fixed_values as V
from hushframe.functions.arrays import blocks, let, part, running

AROUND = 30


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def category_of(kind: Column) -> Column:
    return _lookup(V.CATEGORY_OF_TYPE, kind, "custom")


def prefix_of(kind: Column) -> Column:
    return _lookup(V.PREFIX_OF_TYPE, kind, "REDACTED")


def to_detections(df: DataFrame, text: str = "text") -> DataFrame:
    """``entities`` as ``detections``: category, subcategory, fraction of confidence, placeholder by place in the list,
    context and approval, as the live path of the application gives them."""

    def one(of: Column, n: Column, e: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), e["start"] - AROUND)
        return F.struct(
            F.concat_ws("-", F.lit("detection"), i, e["start"]).alias("id"), e["text"].alias("text"), category_of(e["type"]).alias("category"),
            F.concat(F.upper(F.substring(e["type"], 1, 1)), F.substring(e["type"], 2, 100)).alias("subcategory"), F.lit(0.85).alias("confidence"),
            e["start"].alias("start"), e["end"].alias("end"), F.concat(F.lit("["), prefix_of(e["type"]), F.lit("_"), (i + 1).cast("string"), F.lit("]")).alias("placeholder"),
            part(of, start, F.least(n, e["end"] + AROUND)).alias("context"), F.lit(True).alias("approved"), i.alias("ord"),
        )

    return df.withColumn("detections", let(F.when(F.size("entities") > 0, blocks(F.col(text))), lambda of: let(F.length(text), lambda n: F.transform("entities", lambda e, i: one(of, n, e, i)))))


def valid(d: Column, length: Column) -> Column:
    """Whether a detection counts, in a text of this length (to be computed once a text, not once a detection)."""
    return d["approved"] & (d["start"] >= 0) & (d["end"] > d["start"]) & (d["end"] <= length) & d["placeholder"].isNotNull()


def _joined(of: Column, text: Column, pieces: Column) -> Column:
    """``text`` with the stretches ``pieces`` (start, end, p), which are in order and apart, replaced by their ``p``."""
    ends = lambda j: F.coalesce(F.get(pieces, j - 1)["end"], F.lit(0))
    parts = F.transform(pieces, lambda x, j: F.concat(part(of, F.when(j == 0, 0).otherwise(ends(j)), x["start"]), x["p"]))
    last = F.coalesce(F.get(pieces, F.size(pieces) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(parts, ""), part(of, last, F.length(text)))


def _by_place(at: Column) -> Column:
    """(start, ord, end, p) of detections, in order."""
    return F.sort_array(F.transform(at, lambda d: F.struct(d["start"].alias("start"), d["ord"].alias("ord"), d["end"].alias("end"), d["placeholder"].alias("p"))))


def _reach(s: Column) -> Column:
    """How far the spans up to each one reach."""
    return running(F.transform(s, lambda d: d["end"]), F.greatest)


def _safe(text: Column, at: Column) -> Column:
    """``text`` with each run of spans that meet replaced as a whole, by the placeholder of its longest (then first) span."""

    def runs(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda d, i: F.struct(d["start"].alias("start"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["start"] >= F.get(reach, x["i"] - 1)))

        def one(h: Column, j: Column, all_heads: Column) -> Column:
            size = F.coalesce(F.get(all_heads, j + 1)["i"], F.size(s)) - h["i"]
            longest = F.array_max(F.transform(F.slice(s, h["i"] + 1, size), lambda d: F.struct((d["end"] - d["start"]).alias("n"), (-d["start"]).alias("s"), (-d["ord"]).alias("o"), d["p"].alias("p"))))
            return F.struct(h["start"].alias("start"), F.get(reach, h["i"] + size - 1).alias("end"), longest["p"].alias("p"))

        return let(heads, lambda all_heads: F.transform(all_heads, lambda h, j: one(h, j, all_heads)))

    pieces = let(_by_place(at), lambda s: let(_reach(s), lambda reach: runs(s, reach)))
    return let(pieces, lambda x: let(blocks(text), lambda of: _joined(of, text, x)))


def _spliced(text: Column, at: Column) -> Column:
    """From the last start to the first, each at its places in the original text."""
    order = F.array_sort(at, lambda a, b: F.when(a["start"] != b["start"], b["start"] - a["start"]).otherwise(a["ord"] - b["ord"]))
    return F.aggregate(order, text, lambda acc, d: F.concat(F.substring(acc, F.lit(1), d["start"]), d["placeholder"], F.substring(acc, d["end"] + 1, F.length(acc))))


def _cut(text: Column, at: Column) -> Column:
    """As :func:`_spliced`, for spans within the text: what stands before a span is as it was, so only what follows is put together,
    and an earlier span cuts from it what it reaches over."""
    order = F.sort_array(F.transform(at, lambda d: F.struct((-d["start"]).alias("s"), d["ord"].alias("ord"), d["end"].cast("int").alias("end"), d["placeholder"].alias("p"))))

    def step(of: Column, acc: Column, d: Column) -> Column:
        rest = F.when(d["end"] <= acc["at"], F.concat(part(of, d["end"], acc["at"]), acc["rest"])).otherwise(F.substr(acc["rest"], d["end"] - acc["at"] + 1))
        return F.struct((-d["s"]).cast("int").alias("at"), F.concat(d["p"], rest).alias("rest"))

    whole = lambda of, n: F.aggregate(order, F.struct(n.alias("at"), F.lit("").alias("rest")), lambda acc, d: step(of, acc, d), lambda acc: F.concat(part(of, F.lit(0), acc["at"]), acc["rest"]))
    return let(blocks(text), lambda of: let(F.length(text), lambda n: whole(of, n)))


def masked(text: Column, detections: Column, mode: str = "safe") -> Column:
    """``text`` with approved spans replaced.

    ``compat`` replaces from the last start to the first at the places of the original text, so overlapping spans damage
    what lies between, as the application does; ``safe`` replaces spans that overlap as one, so nothing of any is left;
    ``unchecked`` is ``compat`` without looking whether places lie within the text (beyond its end, it is appended to).
    Texts whose spans lie apart are put together from pieces; only those with overlapping spans in a mode other than ``safe`` are
    put together span by span, each of which costs a copy of what follows it.
    """
    at = let(F.length(text), lambda n: F.filter(detections, lambda d: d["approved"] if mode == "unchecked" else valid(d, n)))
    if mode == "safe":
        return F.when(F.size(at) > 0, _safe(text, at)).otherwise(text)

    def apart(s: Column, reach: Column, n: Column) -> Column:
        return F.forall(F.transform(s, lambda d, i: (d["start"] >= F.when(i == 0, 0).otherwise(F.get(reach, i - 1))) & (d["end"] >= d["start"]) & (d["end"] <= n)), lambda x: x)

    def either(a: Column) -> Column:
        return let(_by_place(a), lambda s: F.when(let(F.length(text), lambda n: let(_reach(s), lambda reach: apart(s, reach, n))), let(blocks(text), lambda of: _joined(of, text, s))).otherwise((_spliced if mode == "unchecked" else _cut)(text, a)))

    return F.when(F.size(at) > 0, let(at, either)).otherwise(text)


def mask(df: DataFrame, text: str = "text", mode: str = "safe") -> DataFrame:
    return df.withColumn("masked_text", F.coalesce(masked(F.col(text), F.col("detections"), mode), F.lit("")))


def numbered(spans: DataFrame, doc: str = "doc_id", template: str = "template", value: str = "value", emission: str = "emission") -> DataFrame:
    """``spans`` with ``number``: the rank of a value's first place among the values of its document and template."""
    norm = F.lower(F.trim(F.col(value)))
    first = F.min(emission).over(Window.partitionBy(doc, template, norm))
    df = spans.withColumn("__first", first)
    return df.withColumn("number", F.dense_rank().over(Window.partitionBy(doc, template).orderBy("__first"))).drop("__first")


def placeholder(template: Column, number: Column) -> Column:
    return F.replace(template, F.lit("{n}"), number.cast("string"))


def segments(text: Column, detections: Column) -> Column:
    """The text in pieces for display: (piece, ord of the detection or null); overlapping spans repeat text."""
    at = F.filter(detections, lambda d: d["approved"] & (d["end"] > d["start"]))

    def of_all(s: Column, of: Column, n: Column) -> Column:
        cut = lambda a, z: part(of, F.least(a, n), F.greatest(F.least(a, n), F.least(z, n)))
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])
        pieces = F.transform(s, lambda d, i: F.array(F.struct(cut(before(i), d["start"]).alias("piece"), F.lit(None).cast("int").alias("ord")), F.struct(cut(d["start"], d["end"]).alias("piece"), d["ord"].cast("int").alias("ord"))))
        rest = F.struct(cut(F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(0)), n).alias("piece"), F.lit(None).cast("int").alias("ord"))
        return F.filter(F.concat(F.flatten(pieces), F.array(rest)), lambda x: x["piece"] != "")

    return let(_by_place(at), lambda s: let(blocks(text), lambda of: let(F.length(text), lambda n: of_all(s, of, n))))


def placeholders_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[[A-Z_]+_\d+\]"), F.lit(0))
