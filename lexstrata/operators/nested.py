"""Nested JSON records to flat, linked tables.

Method: the structural index of functions/structure.py over each batch; tables are then selected by walking member names
over whole arrays of values. Every row keeps the record's id and the places of its parents.

Defined results
  * The packet is the payload's object, or its member ``packet``, or ``envelope.packet``; a payload that is a JSON
    string is read as the text it holds. A byte order mark and white space before the text don't matter.
  * Null, empty, incomplete or otherwise invalid payloads, and such that hold no object, give no rows.
  * A single value in place of a list is a list of one; null or absent lists give no rows; null items give no rows, but
    keep their places. Of a repeated member the last counts.
  * Strings come decoded, numbers and truth values as written, objects and lists as their JSON text; null or absent
    ``finding_id`` and ``status`` are ''. Every record counts by itself, redelivered or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structure import OPEN_O, STRING, JsonIndex
from ..functions.text import WHITE
from ..session import ship

#: Bytes of text indexed at once: the arrays of a batch take about 60 bytes for each.
BATCH_BYTES = 2_000_000
_LEAD = WHITE + "﻿"


def _unwrapped(text: str | None) -> bytes:
    """The JSON text itself, out of strings that hold it; empty if there is none."""
    while text is not None:
        text = text.lstrip(_LEAD)
        if not text.startswith('"'):
            return text.encode("utf-8", "replace")
        raw = text.encode("utf-8", "replace")
        ix = JsonIndex([raw])
        if not ix.valid[0] or ix.kind[ix.root[0]] != STRING:
            return b""
        text = ix.text(ix.root[0])
    return b""


def _packets(ix: JsonIndex) -> np.ndarray:
    root = ix.root
    own = np.where(root >= 0, np.where(ix.kind[np.maximum(root, 0)] == OPEN_O, root, -1), -1) if len(ix.start) else root
    direct = ix.get(own, "packet", OPEN_O)
    nested = ix.get(ix.get(own, "envelope", OPEN_O), "packet", OPEN_O)
    return np.where(direct >= 0, direct, np.where(nested >= 0, nested, own))


def _status(ix: JsonIndex, packets: np.ndarray) -> list[str]:
    return [x or "" for x in ix.texts(ix.get(ix.get(packets, "normalization", OPEN_O), "status"))]


class _Rows:
    """What one batch gives: positions of the packets and findings, and columns as they are asked for."""

    def __init__(self, texts: list[str | None]):
        self.ix = ix = JsonIndex([_unwrapped(t) for t in texts])
        packets = _packets(ix)
        self.doc = np.flatnonzero(packets >= 0)
        self.packet = packets[self.doc]
        self.status = np.array(_status(ix, self.packet), object)
        owner, place, item = ix.items(ix.get(self.packet, "findings"))
        real = ~ix.is_null(item)
        self.f_owner, self.f_pos, self.f = owner[real], place[real], item[real]
        self.f_id = np.array([x or "" for x in ix.texts(ix.get(self.f, "finding_id"))], object)

    def of(self, values: np.ndarray, **names: str) -> dict[str, list]:
        return {out: self.ix.texts(self.ix.get(values, name)) for out, name in names.items()}

    def packets(self) -> tuple[np.ndarray, dict[str, list]]:
        ix, src, norm = self.ix, self.ix.get(self.packet, "source", OPEN_O), self.ix.get(self.packet, "normalization", OPEN_O)
        count = np.bincount(self.f_owner, minlength=len(self.packet)) if len(self.packet) else np.zeros(0, int)
        return self.doc, self.of(self.packet, packet_id="packet_id", schema_version="schema_version") | self.of(
            src, source_path="path", source_kind="source_kind", content_sha256="content_sha256", reviewed_git_revision="reviewed_git_revision", received_at="received_at"
        ) | self.of(norm, method="method", extractor_version="extractor_version") | {"status": list(self.status), "n_findings": list(count)}

    def findings(self) -> tuple[np.ndarray, dict[str, list]]:
        names = ("kind", "concern_class", "reviewer_severity", "summary", "required_proof_class", "normalization_status", "disposition_status", "execution_status", "verification_status")
        return self.doc[self.f_owner], {"finding_pos": list(self.f_pos), "finding_id": list(self.f_id), "status": list(self.status[self.f_owner])} | self.of(self.f, **{n: n for n in names})

    def _below(self, name: str, place: str, **names: str) -> tuple[np.ndarray, dict[str, list]]:
        owner, pos, item = self.ix.items(self.ix.get(self.f, name))
        real = ~self.ix.is_null(item)
        owner, pos, item = owner[real], pos[real], item[real]
        return self.doc[self.f_owner[owner]], {"finding_pos": list(self.f_pos[owner]), place: list(pos), "finding_id": list(self.f_id[owner]), "status": list(self.status[self.f_owner[owner]])} | self.of(item, **names)

    def spans(self) -> tuple[np.ndarray, dict[str, list]]:
        return self._below("source_spans", "span_pos", path="path", line_start="line_start", line_end="line_end", quote_sha256="quote_sha256", heading="heading")

    def targets(self) -> tuple[np.ndarray, dict[str, list]]:
        return self._below("candidate_targets", "target_pos", surface="surface", target_id="id", note="note")

    def events(self) -> tuple[np.ndarray, dict[str, list]]:
        owner, pos, item = self.ix.items(self.ix.get(self.packet, "events"))
        real = ~self.ix.is_null(item)
        owner, pos, item = owner[real], pos[real], item[real]
        return self.doc[owner], {"event_pos": list(pos), "status": list(self.status[owner])} | self.of(item, event_id="event_id", event_type="event_type", at="at", actor_class="actor_class", payload="payload") | self.of(self.ix.get(item, "payload", OPEN_O), disposition="disposition")

    def event_items(self) -> tuple[np.ndarray, dict[str, list]]:
        """The lists inside the payloads of events."""
        ix = self.ix
        owner, pos, item = ix.items(ix.get(self.packet, "events"))
        load = ix.get(item, "payload", OPEN_O)
        docs, cols = [], {"event_pos": [], "list": [], "item_pos": [], "item": []}
        for name in ("evidence_anchors", "non_claims"):
            o, p, i = ix.items(ix.get(load, name))
            real = ~ix.is_null(i)
            o, p, i = o[real], p[real], i[real]
            docs.append(self.doc[owner[o]])
            for c, v in zip(cols.values(), (pos[o], [name] * len(o), p, ix.texts(i))):
                c.extend(v)
        return np.concatenate(docs), cols

    def edges(self) -> tuple[np.ndarray, dict[str, list]]:
        owner, pos, item = self.ix.items(self.ix.get(self.packet, "edges"))
        real = ~self.ix.is_null(item)
        owner, pos, item = owner[real], pos[real], item[real]
        return self.doc[owner], {"edge_pos": list(pos), "status": list(self.status[owner])} | self.of(item, edge_type="type", from_ref="from", to_ref="to", edge_status="status")

    def non_claims(self) -> tuple[np.ndarray, dict[str, list]]:
        ix = self.ix
        o1, p1, i1 = ix.items(ix.get(self.packet, "non_claims"))
        o2, p2, i2 = ix.items(ix.get(self.f, "non_claims"))
        of_packet = np.concatenate([o1, self.f_owner[o2]])
        f_pos = np.concatenate([np.full(len(o1), -1), self.f_pos[o2]])
        f_id = np.concatenate([np.full(len(o1), "", object), self.f_id[o2]])
        pos, item = np.concatenate([p1, p2]), np.concatenate([i1, i2])
        real = ~ix.is_null(item)
        of_packet, f_pos, f_id, pos, item = (x[real] for x in (of_packet, f_pos, f_id, pos, item))
        return self.doc[of_packet], {"finding_pos": list(f_pos), "claim_pos": list(pos), "finding_id": list(f_id), "status": list(self.status[of_packet]), "claim": ix.texts(item)}


_S, _I = pa.string(), pa.int32()
#: Columns of each flat table after the record's id.
TABLES: dict[str, dict[str, pa.DataType]] = {
    "packets": dict.fromkeys(("packet_id", "schema_version", "source_path", "source_kind", "content_sha256", "reviewed_git_revision", "received_at", "method", "extractor_version", "status"), _S) | {"n_findings": _I},
    "findings": {"finding_pos": _I} | dict.fromkeys(("finding_id", "status", "kind", "concern_class", "reviewer_severity", "summary", "required_proof_class", "normalization_status", "disposition_status", "execution_status", "verification_status"), _S),
    "spans": {"finding_pos": _I, "span_pos": _I} | dict.fromkeys(("finding_id", "status", "path", "line_start", "line_end", "quote_sha256", "heading"), _S),
    "targets": {"finding_pos": _I, "target_pos": _I} | dict.fromkeys(("finding_id", "status", "surface", "target_id", "note"), _S),
    "edges": {"edge_pos": _I} | dict.fromkeys(("status", "edge_type", "from_ref", "to_ref", "edge_status"), _S),
    "events": {"event_pos": _I} | dict.fromkeys(("status", "event_id", "event_type", "at", "actor_class", "payload", "disposition"), _S),
    "event_items": {"event_pos": _I, "list": _S, "item_pos": _I, "item": _S},
    "non_claims": {"finding_pos": _I, "claim_pos": _I} | dict.fromkeys(("finding_id", "status", "claim"), _S),
}


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together, a larger row by itself."""
    a = 0
    total = 0
    for i, s in enumerate(sizes):
        if i > a and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def flatten(df: DataFrame, record_id: str, payload: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One of the flat TABLES of the packets in ``payload``: (record_id, the table's columns). No shuffle."""
    ship(df.sparkSession)
    fields = {c: t for c, t in TABLES[name].items() if columns is None or c in columns}
    schema = pa.schema([(record_id, pa.int64()), *fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()])
            for a, z in _slices(sizes * 2, BATCH_BYTES):
                doc, cols = getattr(_Rows(column.slice(a, z - a).to_pylist()), name)()
                arrays = [pa.array(ids[a:z][doc], pa.int64())] + [pa.array(cols[c], t) for c, t in fields.items()]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    kinds = {_S: "string", _I: "int"}
    ddl = f"`{record_id}` bigint, " + ", ".join(f"`{c}` {kinds[t]}" for c, t in fields.items())
    source = df.select(F.col(record_id).cast("bigint").alias(record_id), F.col(payload).cast("string").alias(payload)).filter(F.col(payload).isNotNull() & F.col(record_id).isNotNull())
    return source.mapInArrow(run, ddl)
