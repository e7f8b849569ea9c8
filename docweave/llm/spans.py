"""Per-document span finders as DataFrame operators, and digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPAN = "array<struct<kind:string,start:long,end:long>>"
Span = tuple[str, int, int]


def find_spans(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds base and extra spans (code points, end exclusive) of each text.

    A null text is empty.  `keep` columns are carried along, repeated rows stay."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"base {SPAN}", f"extra {SPAN}"])
    kept = len(keep)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [find(x.as_py() or "") for x in part.column(kept)]
                arrays = [[[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in side] for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *(pa.array(a, kind) for a in arrays)], names=[*part.schema.names[:kept], "base", "extra"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ordered(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """By start and then kind as listed, or by kind as listed and then start."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            *([s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b")] if by_start else [F.array_position(rank, s["kind"]).alias("a"), s["start"].alias("b")]),
            s["end"].alias("c"),
            s.alias("s"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def digest(spans: DataFrame, kinds: list[str], extra_kinds: list[str], by_start: bool) -> DataFrame:
    """doc_id, a count for each kind, base_sha256, spans and n_extra."""
    base = ordered(F.col("base"), kinds, by_start)
    every = ordered(F.concat("base", "extra"), kinds + extra_kinds, by_start)
    return spans.select("doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("extra").cast("long").alias("n_extra"))


def replaced(text: str, spans: list[Span], mark: Callable[[str], str]) -> str:
    """text with mark(kind) for every span; of overlapping ones the first, and the longest at one place, gives the mark."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mark(kind)]
        at = max(at, e)
    return "".join([*out, text[at:]])


def cut_out(docs: DataFrame, find: Callable, mark: Callable[[str], str], more: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by mark(kind) and n_chars
    (where present) following; texts without spans, and null, stay as they are.

    `more` names a column of further spans, which is left out of the result."""
    kept = [f for f in docs.schema.fields if f.name != more]
    names = [f.name for f in kept]
    docs = docs.select(*[F.col(f"`{c}`") for c in [*names, *([more] if more else [])]])
    more_at = len(names) if more else None
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str, further: list | None) -> str:
        base, extra = find(text)
        spans = base + extra + [(x["kind"], x["start"], x["end"]) for x in further or ()]
        return replaced(text, spans, mark) if spans else text

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                old = part.column(text_at).to_pylist()
                further = [None] * len(old) if more_at is None else part.column(more_at).to_pylist()
                new = [None if x is None else clean(x, f) for x, f in zip(old, further, strict=True)]
                cols = list(part.columns)[: len(names)]
                cols[text_at] = pa.array(new, part.column(text_at).type)
                if chars_at is not None:
                    was = part.column(chars_at).to_pylist()
                    cols[chars_at] = pa.array([w if n is o else len(n) for w, o, n in zip(was, old, new, strict=True)], part.column(chars_at).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, StructType(kept))
