"""Offers of a thread folded into one quote: every offer is a revision that replaces the one before.

An ordered fold needs a thread's offers one after the other, not at once: threads are dealt out, offers sorted within tasks and
read as a stream, so a task holds one offer and the lines of the last one, however long a thread is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORG = "organization_id"
_LINE = "struct<line_id:string,supplier_sku:string,item_id:string,stated:string>"
SCHEMA = (
    f"{ORG} string, thread_id string, quote_id string, revision_number int, email_id string, supersedes string, effective boolean, supplier_id string, "
    f"rfq_id string, lines array<{_LINE}>, kept int, added int, dropped int, snapshot string"
)


def next_lines(lines: list[dict], offered: list[dict], email_id: str) -> tuple[list[dict], int]:
    """A quote's lines after an offer, and how many lines of before it kept.

    An offered line goes to the line of its part number (case ignored, none as the empty one; of several, the last), or, where both
    sides have just one line, to that. Such a line keeps its id, and its item where the offer names none; others are new. Lines
    that no offered line went to are gone. Of several offered lines that go to one line the last counts."""
    by_sku = {(x["supplier_sku"] or "").casefold(): k for k, x in enumerate(lines)}
    only = 0 if len(lines) == len(offered) == 1 else None
    took: dict[int, dict] = {}
    new = []
    for n, line in enumerate(offered):
        k = by_sku.get((line["supplier_sku"] or "").casefold(), only)
        if k is None:
            new.append({**line, "line_id": f"{email_id}:{n + 1}"})
        else:
            before = took.get(k, lines[k])
            took[k] = {**line, "line_id": before["line_id"], "item_id": line["item_id"] or before["item_id"]}
    return [took[k] for k in sorted(took)] + new, len(took)


def fold(offers: DataFrame) -> DataFrame:
    """The revisions, one row an offer, of ``offers(organization_id, thread_id, email_id, sent_at, supplier_id, rfq_id, lines, snapshot)``.

    ``lines`` is an array of ``supplier_sku, item_id, stated`` (the line as JSON), null as empty; ``snapshot`` is the offer as JSON. Offers of a thread
    follow each other by time, nulls first, then by id; the last is effective, each supersedes the one before, and the quote is
    named after the first. A quote keeps its supplier and request where an offer has none; of all else the last offer counts. Rows of
    a null thread are one thread; repeated rows are offers of their own; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for o in batch.to_pylist():
                key, offered = (o[ORG], o["thread_id"]), o["lines"] or []
                same = held is not None and (held[ORG], held["thread_id"]) == key
                if held is not None:
                    out.append({**held, "effective": not same})
                lines, kept = next_lines(held["lines"] if same else [], offered, o["email_id"])
                held = {
                    ORG: o[ORG], "thread_id": o["thread_id"], "email_id": o["email_id"], "snapshot": o["snapshot"], "lines": lines, "kept": kept, "added": len(lines) - kept,
                    "quote_id": held["quote_id"] if same else o["email_id"],
                    "revision_number": held["revision_number"] + 1 if same else 1,
                    "supersedes": held["email_id"] if same else None,
                    "dropped": len(held["lines"]) - kept if same else 0,
                    "supplier_id": o["supplier_id"] or (held["supplier_id"] if same else None),
                    "rfq_id": o["rfq_id"] or (held["rfq_id"] if same else None),
                }
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held is not None:
            out.append({**held, "effective": True})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    line = pa.struct([(c, pa.string()) for c in ("line_id", "supplier_sku", "item_id", "stated")])
    kinds = {"revision_number": pa.int32(), "effective": pa.bool_(), "lines": pa.list_(line), "kept": pa.int32(), "added": pa.int32(), "dropped": pa.int32()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])
    text = [F.col(c).cast("string").alias(c) for c in (ORG, "thread_id", "email_id", "supplier_id", "rfq_id")]
    rows = offers.select(*text, "sent_at", "lines", F.col("snapshot").cast("string").alias("snapshot"))
    dealt = rows.repartition(ORG, "thread_id").sortWithinPartitions(ORG, "thread_id", "sent_at", "email_id")
    return dealt.drop("sent_at").mapInArrow(run, SCHEMA)
