"""Digests of ordered record streams as canonical JSON.

SHA-256 is sequential, but its state is a few bytes.  Tasks encode the sorted records, all
parts at a time, and write them as pieces of bytes; then one part after the other is hashed
by a task that goes on from the state the last one left.  What passes through the driver is
that state, whatever the table's size.  ``multiset_digest`` needs no order.
"""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical
from ..functions.hashing import sha
from ..shipping import ship
from ..sources.scratch import scratch

_STATE = 112  # bytes of OpenSSL's SHA256_CTX


def _openssl():
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)  # with the library that hashlib itself is linked to


class Chain:
    """A running SHA-256 over texts and tables of pieces."""

    def __init__(self):
        self.state = bytes(_STATE)
        self._call("SHA256_Init")

    def _call(self, name: str, *args) -> None:
        held = ctypes.create_string_buffer(self.state, _STATE)
        if getattr(_openssl(), name)(held, *args) != 1:
            raise RuntimeError(f"{name} failed")
        self.state = held.raw

    def update(self, data: bytes) -> None:
        self._call("SHA256_Update", data, ctypes.c_size_t(len(data)))

    def table(self, pieces: DataFrame, skip: int = 0) -> None:
        """Go on with pieces (part, place, data) in their order, without the first ``skip`` bytes, which the first piece has."""
        for (part,) in sorted(pieces.select("part").distinct().collect()):
            state, skipped = self.state, skip

            def run(batches, state=state, skipped=skipped):
                chain = Chain()
                chain.state = state
                for batch in batches:
                    for data in batch.column(0):
                        chain.update(data.as_py()[skipped:])
                        skipped = 0
                yield pa.RecordBatch.from_pydict({"state": [chain.state]})

            rows = pieces.where(F.col("part") == part).coalesce(1).sortWithinPartitions("place").select("data")
            self.state, skip = bytes(rows.mapInArrow(run, "state binary").first().state), 0

    def hexdigest(self) -> str:
        held, out = ctypes.create_string_buffer(self.state, _STATE), ctypes.create_string_buffer(32)
        if _openssl().SHA256_Final(out, held) != 1:
            raise RuntimeError("SHA256_Final failed")
        return out.raw.hex()


def encoded(df: DataFrame, order: list[str], columns: list[str], text: Callable[[dict], str]) -> DataFrame:
    """(part, place, data): the records' texts in order, as many in a piece as in a batch."""
    ship(df.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(b for b in batches if b.num_rows):
            data = "".join(text(r) for r in batch.to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([data], pa.binary())], names=["part", "place", "data"])

    path = scratch(df.sparkSession, "pieces")
    df.orderBy(*order).select(*columns).mapInArrow(run, "part int, place int, data binary").write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema("place int, data binary, part int").parquet(path)


def stream_digest(df: DataFrame, order: list[str], columns: list[str]) -> str:
    """Digest of the records, each one canonical JSON and a line feed; nulls stay."""
    out = Chain()
    out.table(encoded(df, order, columns, lambda r: json.dumps(r, sort_keys=True, separators=(",", ":")) + "\n"))
    return out.hexdigest()


def multiset_digest(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """One row, digest: of the table's rows whatever their order, made by all tasks.

    A row's digest is that of its JSON, fields by name; rows are sorted by digest within
    the leading ``digits`` hex digits, and the digests of these 16 ** ``digits`` parts,
    by their leads, make the table's.  More digits keep the parts of larger tables small.
    """
    row = sha(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))
    rows = df.select(row.alias("d")).withColumn("lead", F.substring("d", 1, digits))
    parts = rows.groupBy("lead").agg(sha(F.array_join(F.sort_array(F.collect_list("d")), "\n")).alias("part"))
    every = F.transform(F.sort_array(F.collect_list(F.struct("lead", "part"))), lambda x: x["part"])
    return parts.agg(sha(F.array_join(every, "\n")).alias("digest"))


def _listed(df: DataFrame, order: list[str], columns: list[str], text: Callable[[dict], str] = canonical) -> DataFrame:
    """Pieces of a list's items, each after a comma."""
    return encoded(df, order, columns, lambda r: "," + text(r))


def _array(out: Chain, items: DataFrame) -> None:
    out.update(b"[")
    out.table(items, skip=1)
    out.update(b"]")


def release_digest(slots: DataFrame) -> str:
    """Digest of a release's identities and labels, without texts, by slot."""
    out = Chain()
    _array(out, _listed(slots, ["slot_id"], ["slot_id", "source_content_id", "model_content_id", "label"]))
    return out.hexdigest()


def schedule_digest(order: DataFrame, trajectory_id: int, epochs: int) -> str:
    """Digest of a trajectory's epochs, each the list of its slots in order."""
    out = Chain()
    out.update(b'{"epochs":[')
    for e in range(epochs):
        out.update(b"," if e else b"")
        rows = order.where((F.col("trajectory_id") == trajectory_id) & (F.col("epoch") == e))
        _array(out, _listed(rows, ["place"], ["slot_id"], lambda r: json.dumps(r["slot_id"])))
    out.update(f'],"trajectory_id":{trajectory_id}}}'.encode())
    return out.hexdigest()


def comparison_digests(cases: DataFrame, predictions: DataFrame, slices: DataFrame, members: DataFrame, names: dict[str, str], roles: tuple[str, ...] = ("baseline", "candidate")) -> dict[str, str]:
    """input_sha256 and evaluation_policy_sha256 of a comparison; ``names`` gives the release ids of the roles."""
    listed_cases = _listed(cases, ["case_id"], ["case_id", "expected"])
    answers = {r: _listed(predictions.where(F.col("release_id") == r), ["case_id"], ["case_id", "observed"]) for r in roles}
    held = slices.join(members.select("name").distinct(), "name", "left_semi").orderBy("name").select("name", "maximum_accuracy_drop", "minimum_accuracy").collect()  # a row a slice
    ids = [_listed(members.where((F.col("name") == s.name) & F.col("case_id").isNotNull()), ["case_id"], ["case_id"], lambda r: json.dumps(r["case_id"])) for s in held]

    def digest(with_roles):
        out = Chain()
        out.update(b"{")
        for i, part in enumerate(sorted([*with_roles, "cases", "slices"])):
            out.update((("," if i else "") + json.dumps(part) + ":").encode())
            if part == "cases":
                _array(out, listed_cases)
            elif part == "slices":
                for k, (s, items) in enumerate(zip(held, ids, strict=True)):
                    out.update(b"," if k else b"[")
                    out.update(b'{"case_ids":')
                    _array(out, items)
                    out.update(("," + canonical(s.asDict())[1:]).encode())
                out.update(b"]" if held else b"[]")
            else:
                out.update(b'{"predictions":')
                _array(out, answers[part])
                out.update(f',"release_id":{json.dumps(names[part])}}}'.encode())
        out.update(b"}")
        return out.hexdigest()

    return {"input_sha256": digest(roles), "evaluation_policy_sha256": digest(roles[:1])}
