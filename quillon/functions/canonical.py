"""Canonical serialisation and fingerprints of operation streams.

ops: (circuit, idx long, name string, qubits array<int>, classical_bits array<int>, parameters array<string>).
Order is the idx column, never the place of a row.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the serialisation and fingerprint schemes.
SCHEMA = "structural-fingerprint/v1"
PREFIX = f"{SCHEMA}:sha256:"


def json_text(value: Column) -> Column:
    """An ASCII JSON string: all but printable ASCII is escaped, by UTF-16 units."""
    plain = F.regexp_replace(value, r'(["\\])', r"\\$1")
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(value, "UTF-16BE"))), F.lit(".{4}"), F.lit(0))

    def unit(x: Column) -> Column:
        short = F.when(x == "0022", '\\"').when(x == "005c", "\\\\").when(x == "0008", "\\b").when(x == "0009", "\\t").when(x == "000a", "\\n").when(x == "000c", "\\f").when(x == "000d", "\\r")
        return short.when((x >= "0020") & (x <= "007e"), F.chr(F.conv(x, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), x))

    return F.concat(F.lit('"'), F.when(value.rlike(r"\A[ -~]*\z"), plain).otherwise(F.array_join(F.transform(units, unit), "")), F.lit('"'))


def json_array(values: Column, text: bool = False) -> Column:
    parts = F.transform(values, lambda x: json_text(x) if text else x.cast("string"))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def operation(index: bool = True) -> Column:
    """Compact text of an operation; without its index it is a token for shingles."""
    body = [json_text(F.col("name")), F.lit(","), json_array(F.col("qubits")), F.lit(","), json_array(F.col("classical_bits")), F.lit(","), json_array(F.col("parameters"), text=True), F.lit("]")]
    head = [F.lit("["), F.col("idx").cast("string"), F.lit(",")] if index else [F.lit("[")]
    return F.concat(*head, *body)


def bit_counts(ops: DataFrame) -> DataFrame:
    """circuit, qubits and classical bits in use: the largest index and one."""
    used = lambda c: F.coalesce(F.max(F.array_max(c)) + 1, F.lit(0))
    return ops.groupBy("circuit").agg(used("qubits").alias("q"), used("classical_bits").alias("c"))


def fingerprints(ops: DataFrame) -> DataFrame:
    """circuit, fingerprint of moderate circuits: one ordered list each, hashed in the JVM."""
    listed = ops.groupBy("circuit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", operation().alias("text")))), lambda x: x["text"]), ",").alias("body"))
    text = F.concat(F.lit(f'["{SCHEMA}",'), F.col("q").cast("string"), F.lit(","), F.col("c").cast("string"), F.lit(",["), F.col("body"), F.lit("]]"))
    return listed.join(bit_counts(ops), "circuit").select("circuit", F.concat(F.lit(PREFIX), F.sha2(text, 256)).alias("fingerprint"))


def streamed_fingerprints(ops: DataFrame) -> DataFrame:
    """The same fingerprints for circuits of any length: sorted rows pass an incremental hash, one circuit at a time."""
    kind = ops.schema["circuit"].dataType.simpleString()
    rows = ops.select("circuit", "idx", operation().alias("text")).join(bit_counts(ops), "circuit")
    rows = rows.repartition("circuit").sortWithinPartitions("circuit", "idx")

    def run(batches):
        circuit, state, begun = None, None, False
        for batch in batches:
            done: list[tuple] = []
            owners, texts = batch.column("circuit").to_pylist(), batch.column("text").to_pylist()
            heads = [i for i in range(len(owners)) if not i or owners[i] != owners[i - 1]]
            for a, b in zip(heads, [*heads[1:], len(owners)], strict=True):  # a stretch of one circuit
                if not begun or owners[a] != circuit:
                    if begun:
                        state.update(b"]]")
                        done.append((circuit, PREFIX + state.hexdigest()))
                    circuit, begun = owners[a], True
                    state = hashlib.sha256(f'["{SCHEMA}",{batch.column("q")[a].as_py()},{batch.column("c")[a].as_py()},['.encode())
                else:
                    state.update(b",")
                state.update(",".join(texts[a:b]).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], batch.schema.field("circuit").type), pa.array([y for _, y in done])], names=["circuit", "fingerprint"])
        if begun:
            state.update(b"]]")
            yield pa.RecordBatch.from_pydict({"circuit": [circuit], "fingerprint": [PREFIX + state.hexdigest()]})

    return rows.mapInArrow(run, f"circuit {kind}, fingerprint string")


def reference_fingerprint(q: int, c: int, ops: list[tuple]) -> str:
    """The definition, for tests: sha256 of compact JSON."""
    return PREFIX + hashlib.sha256(json.dumps([SCHEMA, q, c, [list(o) for o in ops]], separators=(",", ":")).encode()).hexdigest()


def duplicate_groups(df: DataFrame, fingerprint: str, key: str) -> DataFrame:
    """Fingerprints with several members: size and smallest member; members are never gathered."""
    return df.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.count("*").alias("members"), F.min(key).alias("first_member")).where("members > 1")


def identifier(*parts: Column) -> Column:
    """A deterministic 32-character id."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def blake2b64(text: Column) -> Column:
    """BLAKE2b of 8 bytes, as 16 hex digits: the JVM has none. Null for null."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())

    return digest(text)


def summary(ops: DataFrame) -> DataFrame:
    """circuit, fingerprint, qubit_count, classical_bit_count, operation_count: what an analysis records."""
    counts = ops.groupBy("circuit").agg(F.count("*").alias("operation_count"))
    bits = bit_counts(ops).select("circuit", F.col("q").alias("qubit_count"), F.col("c").alias("classical_bit_count"))
    return fingerprints(ops).join(bits, "circuit").join(counts, "circuit")


def circuit_depth(ops: DataFrame) -> DataFrame:
    """circuit, depth: the longest chain of operations that share qubits or bits. A step follows its operands' levels in
    index order, which is sequential in a circuit; sorted rows are streamed and only the levels are kept."""
    kind = ops.schema["circuit"].dataType.simpleString()
    rows = ops.select("circuit", "idx", F.concat(F.coalesce("qubits", F.array().cast("array<int>")), F.transform(F.coalesce("classical_bits", F.array().cast("array<int>")), lambda x: -1 - x)).alias("used"))
    rows = rows.repartition("circuit").sortWithinPartitions("circuit", "idx")

    def run(batches):
        circuit, levels, begun = None, {}, False
        for batch in batches:
            out = []
            for c, used in zip(batch.column("circuit").to_pylist(), batch.column("used").to_pylist(), strict=True):
                if begun and c != circuit:
                    out.append((circuit, max(levels.values(), default=0)))
                    levels = {}
                circuit, begun = c, True
                level = 1 + max((levels.get(u, 0) for u in used), default=0)
                levels.update(dict.fromkeys(used, level))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out], pa.int64())], names=["circuit", "depth"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([circuit]), pa.array([max(levels.values(), default=0)], pa.int64())], names=["circuit", "depth"])

    return rows.mapInArrow(run, f"circuit {kind}, depth long")


def gate_counts(ops: DataFrame) -> DataFrame:
    """circuit, name, n."""
    return ops.groupBy("circuit", "name").agg(F.count("*").alias("n"))


def arity_counts(ops: DataFrame) -> DataFrame:
    """Operations of each kind by circuit: one-, two- and multi-qubit gates, measures, resets, barriers, and all."""
    special = F.col("name").isin("measure", "reset", "barrier")
    size = F.size(F.array_distinct("qubits"))
    count = lambda c: F.count_if(c)
    return ops.groupBy("circuit").agg(count(~special & (size == 1)).alias("one_qubit"), count(~special & (size == 2)).alias("two_qubit"), count(~special & (size > 2)).alias("multi_qubit"), count(F.col("name") == "measure").alias("measures"), count(F.col("name") == "reset").alias("resets"), count(F.col("name") == "barrier").alias("barriers"), F.count("*").alias("total"))


def rounded_parameters(ops: DataFrame, digits: int = 9) -> DataFrame:
    """Numeric parameters rounded to so many digits: a fingerprint of them ignores noise below that. Text stays."""
    return ops.withColumn("parameters", F.transform("parameters", lambda x: F.coalesce(F.format_string(f"%.{digits}f", F.round(x.try_cast("double"), digits)), x)))


def exact_parameters(ops: DataFrame) -> DataFrame:
    """Numeric parameters as hexadecimal floats: a fingerprint of them tells any two doubles apart."""
    @F.pandas_udf("array<string>")
    def exact(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return float(x).hex()
            except ValueError:
                return x

        return values.map(lambda xs: None if xs is None else [one(x) for x in xs])

    return ops.withColumn("parameters", exact("parameters"))
