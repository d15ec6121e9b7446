"""Token ids in files of bit-plane-shuffled, compressed chunks.

Documents are dealt by range of their id to ordered parts, and a part is one run
of ids in ascending order of documents.  The run is cut into chunks of CHUNK ids,
whatever the documents' bounds; a chunk is transposed into planes (of one bit, or
of one byte), each plane is compressed with zstandard on its own, and one Parquet
row stores the chunk: part, chunk, unit, planes, and which documents it holds ids of.
A plane without a set bit is left out.  Beside these rows the table ``index`` has,
for each chunk, the place of its first id in the part, the ids of a whole chunk and
the bytes of its planes, and the table ``documents`` the place of each document.
``read_ids`` finds the chunks of given documents by these two and reads no others.
Parquet rows are the container since only Spark's writers reach every store.

Results in the odd cases: null text counts as empty and has the end id alone;
null ids come first; rows that repeat an id follow one another in order of the
first LEAD characters of their texts, so they may lie in several parts; an empty
table gives empty files; other columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.llm.common import CLEANUP, arrow_rows, releasing, setting, shared_dir, shuffle_partitions, written
from veriloom.llm.tokens import HELD, encoder, slices

#: Ids of a chunk.
CHUNK = 1 << 16
LEVEL = 3
#: Rows are of three kinds: a chunk, its entry in the index, a document's place.
FILE = "kind string, part int, chunk long, first_id long, n_ids long, unit string, chunk_ids long, planes array<binary>, plane_bytes array<long>, docs array<struct<ordinal:bigint,first_id:bigint,n_tokens:bigint>>, ordinal long, doc_id long"
#: Characters of a text that order rows of one id, and rows of a part.
LEAD, ROWS = 64, 100_000


def shuffled(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """The planes of 32-bit ids, lowest first, up to the highest that has a set bit."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    bits = int(ids.max(initial=0)).bit_length()
    if unit == "byte":
        return [raw[:, k].tobytes() for k in range(-(-bits // 8))]
    low = [np.ascontiguousarray(raw[:, k]) for k in range(-(-bits // 8))]
    return [np.packbits(low[k // 8] & np.uint8(1 << (k % 8)), bitorder="little").tobytes() for k in range(bits)]


def restored(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if unit == "byte":
            raw[k] = np.frombuffer(plane, np.uint8)
        else:
            raw[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


DOCS = pa.list_(pa.struct([("ordinal", pa.int64()), ("first_id", pa.int64()), ("n_tokens", pa.int64())]))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), DOCS, pa.int64(), pa.int64())
    names = ("kind", "part", "chunk", "first_id", "n_ids", "unit", "chunk_ids", "planes", "plane_bytes", "docs", "ordinal", "doc_id")
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _encode(path: str, end: int, chunk: int, unit: str, held_pieces: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, own, last = TaskContext.get().partitionId(), encoder(path, held_pieces), np.array([end], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL)
        held, spans, number, at, ordinal = bytearray(), [], 0, 0, 0

        def chunks(least: int) -> Iterator[tuple]:
            nonlocal number, spans
            while len(held) >= 4 * least and held:
                ids = np.frombuffer(bytes(held[: 4 * chunk]), "<u4")
                first, planes = number * chunk, [press.compress(x) for x in shuffled(ids, unit)]
                sizes, until = [len(x) for x in planes], first + len(ids)
                yield "chunk", part, number, first, len(ids), unit, chunk, planes, sizes, [x for x in spans if x[1] < until], None, None
                yield "index", part, number, first, len(ids), unit, chunk, None, sizes, None, None, None
                spans = [x for x in spans if x[1] + x[2] > until]
                del held[: 4 * chunk]
                number += 1

        for batch in batches:
            for piece in slices(batch, rows=2000):
                rows = []
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), own.encode(piece.column("text")), strict=True):
                    held += ids + last
                    n = len(ids) // 4 + 1
                    rows.append(("document", part, None, at, n, None, None, None, None, None, ordinal, doc_id))
                    spans.append((ordinal, at, n))
                    at, ordinal = at + n, ordinal + 1
                    rows += chunks(chunk)
                yield _rows(rows)
        yield _rows(list(chunks(1)))

    return run


def write_ids(docs: DataFrame, path: str, out: str, end: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, unit: str = "bit", parts: int | None = None, held: int = HELD) -> None:
    """Encodes the documents and writes the files to the folder ``out``.

    Without ``parts`` a part has about ROWS rows.  ``held`` bounds the memory of
    pieces of text that come again (see ``tokens``).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = parts or max(shuffle_partitions(spark), -(-rows.count() // ROWS))
    # the last key parts rows that are equal in id and text
    keys = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, LEAD), F.col("tie")]
    order = rows.withColumn("tie", F.rand(5)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    with arrow_rows(spark, 2000), setting(spark, CLEANUP, "true"):
        order.mapInArrow(releasing(_encode(path, end, chunk, unit, held)), FILE).write.partitionBy("kind").parquet(out)


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Places in the whole run of ids: doc_id, part, ordinal, first_id (in the part), start, n_tokens."""
    rows = spark.read.schema(FILE).parquet(out)
    # one row per part; parts are as many as write_ids made
    sums = rows.where("kind = 'document'").groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = rows.where("kind = 'document'").join(F.broadcast(sums.select("part", before.alias("before"))), "part")
    return places.select("doc_id", "part", "ordinal", "first_id", (F.col("before") + F.col("first_id")).alias("start"), F.col("n_ids").alias("n_tokens"))


def _ids(row: dict, press) -> np.ndarray:
    return restored([press.decompress(x) for x in row["planes"]], row["n_ids"], row["unit"])


def _restore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each document's ids in each chunk."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            ids, crcs = _ids(row, press).tobytes(), []
            for d in row["docs"]:
                a = max(d["first_id"], row["first_id"]) - row["first_id"]
                b = min(d["first_id"] + d["n_tokens"], row["first_id"] + row["n_ids"]) - row["first_id"]
                crcs.append((d["ordinal"], a + row["first_id"] - d["first_id"], b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*crcs, strict=True)) or [()] * 4
            arrays = [pa.array([row["part"]] * len(crcs), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "ordinal", "at", "n", "crc"])


def _taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids from ``a`` to ``b`` of a chunk."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        ids = [_ids(row, press)[row["a"] : row["b"]].tolist() for row in batch.select(["planes", "n_ids", "unit", "a", "b"]).to_pylist()]
        kept = ["part", "ordinal", "doc_id", "chunk"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(ids, pa.list_(pa.int64()))], names=[*kept, "ids"])


def read_ids(spark: SparkSession, out: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids of the documents whose id is in ``wanted``; of chunks, only those that hold ids of theirs are decompressed."""
    rows = spark.read.schema(FILE).parquet(out)
    places = rows.where("kind = 'document'").select("part", "ordinal", "doc_id", F.col("first_id").alias("at"), F.col("n_ids").alias("n"))
    places = places.join(wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    index = rows.where("kind = 'index'").select("part", "chunk", "first_id", "n_ids", "chunk_ids")
    size = index.groupBy("part").agg(F.max("chunk_ids").alias("size"))
    each = places.join(size, "part").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / F.col("size")), F.floor((F.col("at") + F.col("n") - 1) / F.col("size")))))
    a, b = F.greatest("at", "first_id") - F.col("first_id"), F.least(F.col("at") + F.col("n"), F.col("first_id") + F.col("n_ids")) - F.col("first_id")
    spans = each.join(index, ["part", "chunk"]).select("part", "chunk", "ordinal", "doc_id", a.alias("a"), b.alias("b"))
    found = rows.where("kind = 'chunk'").select("part", "chunk", "planes", "n_ids", "unit").join(spans, ["part", "chunk"])
    pieces = found.mapInArrow(releasing(_taken), "part int, ordinal long, doc_id long, chunk long, ids array<long>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    return pieces.groupBy("part", "ordinal", "doc_id").agg(joined.alias("ids")).select("doc_id", "ids")


def crc_joined(first: int, second: int, size: int) -> int:
    """crc32 of a + b from those of a and of b, where b has ``size`` bytes.

    Appending zero bytes is linear over GF(2): the matrix for one zero bit,
    squared again and again, carries ``first`` past b.
    """
    if not size:
        return first

    def times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector, k = vector >> 1, k + 1
        return out

    power, bits = [0xEDB88320, *(1 << k for k in range(31))], 8 * size
    while bits:
        if bits & 1:
            first = times(power, first)
        power, bits = [times(power, x) for x in power], bits >> 1
    return first ^ second


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = []
        for pieces in batch.column("pieces").to_pylist():
            crc = 0
            for x in pieces:
                crc = crc_joined(crc, x["crc"], 4 * x["n"])
            whole.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ordinal"), batch.column("found"), pa.array(whole, pa.int64())], names=["part", "ordinal", "found", "ids_crc32"])


def read_crcs(spark: SparkSession, out: str) -> DataFrame:
    """Restores every chunk and returns per document: doc_id, start, n_tokens, ids_crc32.

    A chunk says which documents it holds part of; a document in several chunks gets
    its checksum from those of its pieces.
    """
    chunks = spark.read.schema(FILE).parquet(out).where("kind = 'chunk'").select("part", "first_id", "n_ids", "unit", "planes", "docs")
    # restored once, for both kinds of documents below
    pieces = written(chunks.mapInArrow(releasing(_restore), "part int, ordinal long, at long, n long, crc long"), "crcs", rows=64)
    places = read_documents(spark, out)
    joined = pieces.groupBy("part", "ordinal").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"), F.sum("n").alias("found"))
    # nearly all documents lie in one chunk; only the others go through Python
    one = joined.where(F.size("pieces") == 1).select("part", "ordinal", "found", F.col("pieces")[0]["crc"].alias("ids_crc32"))
    more = joined.where(F.size("pieces") > 1).mapInArrow(_joined, "part int, ordinal long, found long, ids_crc32 long")
    crcs = one.unionByName(more)
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long"))
    return places.join(crcs, ["part", "ordinal"], "left").select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, end: int, **options) -> DataFrame:
    """Writes the documents' ids under the shared folder and reads them back."""
    out = f"{shared_dir(docs.sparkSession)}/veriloom/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, out, end, **options)
    return read_crcs(docs.sparkSession, out)
