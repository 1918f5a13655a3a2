"""Sources: nested JSON, circuit text, packed operation files, logs, headed tables, artifacts."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder, registered as views. Tables that are not there are left out: callers adapt."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found[name].createOrReplaceTempView(name)
    return found


def capabilities(found: dict[str, DataFrame], name: str, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that a table has."""
    return [c for c in wanted if name in found and c in found[name].columns]


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Versions and edges of a manifest: one JSON document with `versions` and `transformation_edges`."""
    doc = spark.read.option("multiLine", True).json(path)
    versions = doc.select(F.explode("versions").alias("v")).select("v.*")
    edges = doc.select(F.explode("transformation_edges").alias("e")).select(F.col("e.edge_id"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.relation"))
    return versions, edges


def array_elements(body: str, field: str) -> list[str]:
    """The elements of a top-level array of a JSON object as they are written, numbers digit for digit."""
    read, at, found = json.JSONDecoder().raw_decode, 0, []
    at = re.compile(r"\s*\{\s*").match(body, at).end()
    while at < len(body) and body[at] != "}":
        key, at = read(body, at)
        at = re.compile(r"\s*:\s*").match(body, at).end()
        if key == field and body[at] == "[":
            at = re.compile(r"[\s,]*").match(body, at + 1).end()
            while body[at] != "]":
                _, end = read(body, at)
                found.append(body[at:end])
                at = re.compile(r"[\s,]*").match(body, end).end()
            at += 1
        else:
            _, at = read(body, at)
        at = re.compile(r"[\s,]*").match(body, at).end()
    return found


def api_body(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of {"submissions": [...]} bodies, each with its text as written and the body's sha256.

    A body that is not JSON gives no records. Python only cuts the texts apart; Spark reads the fields.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for snapshot, body in zip(batch.column("snapshot_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    rows += [(snapshot, i, raw) for i, raw in enumerate(array_elements(body, "submissions"))]
                except (ValueError, IndexError, AttributeError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["snapshot_id", "ordinal", "raw"])

    body = spark.read.text(path, wholetext=True).select(F.sha2("value", 256).alias("snapshot_id"), "value")
    raw = body.mapInArrow(run, "snapshot_id string, ordinal long, raw string")
    return raw.withColumn("record", F.from_json("raw", schema)).select("snapshot_id", "ordinal", "raw", "record.*")


def sidecar_mismatches(spark: SparkSession, path: str) -> DataFrame:
    """path of files whose sha256 is not the first word of the file of their name and .sha256; a missing one is none."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    sides = files.where(F.endswith("path", F.lit(".sha256"))).select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.lower(F.regexp_extract("text", r"^\s*([0-9A-Fa-f]{64})", 1)).alias("wanted"))
    return files.join(sides, "path").where("sha256 <> wanted").select("path")


def trailers(log: DataFrame, key: str, message: str) -> DataFrame:
    """key, name, value of the trailer lines (Name: value) in the last paragraph of commit messages."""
    last = F.element_at(F.split(F.trim(F.regexp_replace(message, "\r", "")), r"\n\s*\n"), -1)
    lines = log.select(key, F.explode(F.split(last, "\n")).alias("line")).where(F.col("line").rlike(r"^[A-Za-z0-9-]+:\s"))
    return lines.select(key, F.regexp_extract("line", r"^([A-Za-z0-9-]+):", 1).alias("name"), F.trim(F.regexp_extract("line", r"^[A-Za-z0-9-]+:\s*(.*)$", 1)).alias("value"))


def pinned_files(spark: SparkSession, path: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (name, sha256, content) that match the expected hashes, and the expected ones without a match."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")
    return files.join(expected, ["name", "sha256"], "left_semi"), expected.join(files.select("name", "sha256"), ["name", "sha256"], "left_anti")


def delimited_log(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A dumped log whose records end in 0x1e and fields in 0x1f."""
    lines = spark.read.text(path, lineSep="\x1e").select(F.split("value", "\x1f").alias("p"))
    return lines.where(F.size("p") >= len(fields)).select(*(F.regexp_replace(F.col("p")[i], r"^\s+|\s+$", "").alias(f) for i, f in enumerate(fields)))


def headed_lines(lines: DataFrame, by: Sequence[str], order: Sequence[str], heading: str) -> DataFrame:
    """Lines (text) with the last heading at or before them, the pattern's first group; heading lines go."""
    found = F.regexp_extract("text", heading, 1)
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("_h", F.when(F.col("text").rlike(heading), found)).withColumn("heading", F.last("_h", ignorenulls=True).over(w)).where("_h is null").drop("_h")


_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"


def qasm_counts(texts: DataFrame) -> DataFrame:
    """Operation names and counts of circuit texts (path, source): path, name, n. Definitions and headers are left out."""
    body = F.regexp_replace(F.regexp_replace("source", _COMMENT, " "), r"\b(?:gate|opaque)\b[^{;]*(?:\{[^}]*\}|;)", " ")
    statements = texts.select("path", F.explode(F.split(body, ";")).alias("s")).select("path", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("s"))
    plain = F.regexp_replace("s", r"^if ?\([^)]*\) ?", "")
    name = F.regexp_extract(plain, r"^([A-Za-z_][A-Za-z0-9_]*)", 1)
    measured = F.when(plain.rlike(r"\bmeasure\b|->"), "measure").otherwise(name)
    ops = statements.select("path", measured.alias("name")).where("name <> '' and lower(name) not in ('openqasm', 'include', 'qreg', 'creg', 'qubit', 'bit')")
    return ops.groupBy("path", "name").agg(F.count("*").alias("n"))


def qasm_registers(texts: DataFrame) -> DataFrame:
    """path, qubit_count, bit_count from register declarations."""
    total = lambda word: F.aggregate(F.regexp_extract_all("source", F.lit(rf"\b{word}\s+\w+\s*\[\s*(\d+)\s*\]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    return texts.select("path", total("qreg").alias("qubit_count"), total("creg").alias("bit_count"))


_STATEMENT = re.compile(r"^(?:if\s*\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\))?\s*(.*)$", re.S)
_OPERAND = re.compile(r"^\s*(\w+)\s*(?:\[\s*(\d+)\s*\])?\s*$")

OPS = "circuit string, idx long, name string, qubits array<int>, classical_bits array<int>, parameters array<string>, error string"


def _operations(source: str):
    """Operations of one circuit text; registers get dense numbers in the order of their declarations."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", source, flags=re.S)
    text = re.sub(r"\b(?:gate|opaque)\b[^{;]*(?:\{[^}]*\}|;)", " ", text)
    quantum: dict[str, tuple[int, int]] = {}
    classical: dict[str, tuple[int, int]] = {}
    used = [0, 0]
    idx = 0
    for raw in text.split(";"):
        s = " ".join(raw.split())
        if not s or re.match(r"(?i)openqasm|include", s):
            continue
        if m := re.match(r"(qreg|creg)\s+(\w+)\s*\[\s*(\d+)\s*\]$", s):
            k = m[1] == "creg"
            (classical if k else quantum)[m[2]] = (used[k], int(m[3]))
            used[k] += int(m[3])
            continue
        m = _STATEMENT.match(s)
        if not m:
            raise ValueError(f"not a statement: {s[:80]}")
        sides = [x.split(",") for x in m[3].split("->")]
        groups = []
        for side, registers in zip(sides, (quantum, classical), strict=False):
            for operand in side:
                o = _OPERAND.match(operand)
                if not o or o[1] not in registers:
                    raise ValueError(f"unknown operand {operand.strip()!r}")
                base, size = registers[o[1]]
                groups.append((registers is classical, [base + int(o[2])] if o[2] else list(range(base, base + size))))
        parameters = [p.strip() for p in m[2].split(",")] if m[2] else []
        if m[1] == "barrier":
            yield idx, m[1], [q for _, g in groups for q in g], [], parameters
            idx += 1
            continue
        # whole registers broadcast over their members
        for k in range(max((len(g) for _, g in groups), default=1)):
            pick = [(c, g[k] if len(g) > 1 else g[0]) for c, g in groups]
            yield idx, m[1], [v for c, v in pick if not c], [v for c, v in pick if c], parameters
            idx += 1


def qasm_operations(texts: DataFrame) -> DataFrame:
    """Operation streams of circuit texts (path, source); a text that cannot be read gives one row with its error."""

    def run(batches):
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    rows = [(path, *op, None) for op in _operations(source or "")]
                except (ValueError, IndexError) as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
                    names = ("circuit", "idx", "name", "qubits", "classical_bits", "parameters", "error")
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select("path", "source").mapInArrow(run, OPS)


RECORD = 56
HEADER = "<8sQ"


def packed_header(spark: SparkSession, path: str) -> DataFrame:
    """path, magic and operation count of packed operation files, from the first 16 bytes and without Python."""
    hexes = F.hex(F.substring("content", 9, 8))
    count = F.conv(F.array_join(F.reverse(F.regexp_extract_all(hexes, F.lit("(..)"), F.lit(1))), ""), 16, 10).cast("decimal(20,0)").cast("long")
    return spark.read.format("binaryFile").load(path).select("path", F.decode(F.substring("content", 1, 8), "US-ASCII").alias("magic"), count.alias("operations"))


# Kinds of packed operations by number, and the fields of a record.
KINDS = ("neg", "register", "append_to_register", "bit_invert", "bit_store0", "bit_store1", "x", "z", "cx", "cz", "swap", "r", "hmr", "ccx", "ccz", "push_condition", "pop_condition", "debug_print")
FIELDS = np.dtype([("kind", "<u4"), ("pad", "<u4"), ("control2", "<u8"), ("control1", "<u8"), ("target", "<u8"), ("bit", "<u8"), ("condition", "<u8"), ("register", "<u8")])
UNUSED = np.uint64(2**64 - 1)


def _blocks(batches, block_records: int):
    """(file, first record, bytes of whole records) of packed operation files, unpacked a block at a time."""
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = memoryview(content.as_buffer())
            if len(data) < struct.calcsize(HEADER):
                raise ValueError(f"{name} has no header")
            _, count = struct.unpack_from(HEADER, data)
            reader, at = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data[struct.calcsize(HEADER) :]), 0
            while at < count:
                want = min(block_records, count - at) * RECORD
                part = bytearray()
                while len(part) < want and (more := reader.read(want - len(part))):
                    part += more
                if len(part) < want:
                    raise ValueError(f"{name} ends after {at + len(part) // RECORD} of {count} records")
                yield name, at, bytes(part)
                at += want // RECORD


def packed_records(spark: SparkSession, path: str, block_records: int = 65_536) -> DataFrame:
    """path, idx, record (binary) of packed operation files: a 16-byte header and zstd-packed 56-byte records, streamed."""

    def run(batches):
        for name, at, part in _blocks(batches, block_records):
            n = len(part) // RECORD
            records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD), n, [None, pa.py_buffer(part)])
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), records.cast(pa.binary())], names=["path", "idx", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, record binary")


def _lists(columns: list[np.ndarray], kind: pa.DataType, text: Sequence[str] = ()) -> pa.Array:
    """For each row the list of its used columns, as numbers or as <name>=<number>."""
    table = np.stack(columns, axis=1)
    used = table != UNUSED
    values = table[used]
    if text:
        names = np.broadcast_to(np.array(text), table.shape)[used]
        flat = pa.array([f"{n}={v}" for n, v in zip(names.tolist(), values.tolist(), strict=True)], kind)
    else:
        flat = pa.array(values.astype(np.int64), kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)), flat)


def packed_operations(spark: SparkSession, path: str, block_records: int = 65_536) -> DataFrame:
    """circuit (the path), idx, name, qubits, classical_bits, parameters of packed operation files, a block at a time."""

    def run(batches):
        for name, at, part in _blocks(batches, block_records):
            x = np.frombuffer(part, dtype=FIELDS)
            if (x["kind"] >= len(KINDS)).any():
                bad = int(np.flatnonzero(x["kind"] >= len(KINDS))[0])
                raise ValueError(f"{name}: record {at + bad} has the unknown kind {x['kind'][bad]}")
            names = pa.DictionaryArray.from_arrays(pa.array(x["kind"].astype(np.int32)), pa.array(KINDS)).cast(pa.string())
            qubits = _lists([x["control2"], x["control1"], x["target"]], pa.int64())
            parameters = _lists([x["register"], x["condition"]], pa.string(), ("r_target", "c_condition"))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(at, at + len(x))), names, qubits, _lists([x["bit"]], pa.int64()), parameters], names=["circuit", "idx", "name", "qubits", "classical_bits", "parameters"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "circuit string, idx long, name string, qubits array<long>, classical_bits array<long>, parameters array<string>")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def optimization_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run of a pass-order dataset."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.select(F.explode("circuits").alias("c")).select("c.source_id", "c.name", "c.baseline", F.explode("c.runs").alias("r"))
    return rows.select("source_id", "name", "baseline", "r.order", "r.run_id", "r.status", "r.verified", "r.final", "r.steps")


def optimization_problems(runs: DataFrame) -> DataFrame:
    """Violated rules of a pass-order dataset: rule, violations."""
    checks = {
        "duplicate_run": runs.groupBy("run_id").count().where("count > 1"),
        "last_step_is_final": runs.where(F.size("steps") > 0).where(~F.element_at("steps", -1).eqNullSafe(F.col("final"))),
        "duplicate_order": runs.groupBy("source_id", "order").count().where("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def optimization_steps(runs: DataFrame) -> DataFrame:
    """One row for each step of each run: run_id, step, metrics."""
    return runs.select("source_id", "run_id", "order", F.posexplode("steps").alias("step", "metrics"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Version records of a folder of JSON documents, one each; fields that some lack are null."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)


def gate_histogram(records: DataFrame, key: str = "circuit_id") -> DataFrame:
    """key, name, n from a struct column metrics.gate_histogram; absent gates give no row."""
    names = [f.name for f in records.schema["metrics"].dataType["gate_histogram"].dataType]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"metrics.gate_histogram.`{n}`").cast("long").alias("n")) for n in names))
    return records.select(key, F.explode(pairs).alias("g")).select(key, "g.*").where("n is not null")
