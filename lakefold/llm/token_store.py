"""Token-ID output as a content-addressed store.

Texts are encoded to ids. A rolling hash over the ids cuts each document's stream into chunks; a chunk is named by 128
bits of the SHA-256 of its bytes and stored once, by the first pack (run of ascending doc_id) that holds it. A document is a recipe
of chunk names; packs and the corpus have Merkle roots over the recipes.

File format, below the store's folder:
  packs/pack=N/*.parquet     a row per document, ascending doc_id: doc_id, ord, start, n_tokens, chunk_sha, chunk_len,
                             owner (-1: the bytes are in this row's data; -2: earlier in this pack, else the pack that
                             has them), lent (other rows read this chunk), leaf (SHA-256 of the chunk names), data
  manifest/*.parquet         a row per pack: pack, n_docs, n_tokens, start, root
  corpus/*.parquet           one row: n_docs, n_tokens, and root over the packs' roots in their order

Nulls and ties: a null text is empty; a null doc_id sorts before all others; rows with the same doc_id are kept, ordered
by their ids. An empty table gives a store without packs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefold.llm import textkit
from lakefold.llm.unit_encoder import encoder
from lakefold.session import delete, group_count, scratch_path

CHUNK_MIN, CHUNK_MASK, CHUNK_MAX, CHUNK_WINDOW = 64, 255, 4096, 8


def _name(chunk: bytes) -> bytes:
    """128 bits of SHA-256."""
    return hashlib.sha256(chunk).digest()[:16]


def chunk_lengths(ids: np.ndarray) -> list[int]:
    """Lengths of the chunks of an id stream: a cut follows an id where the hash of the last CHUNK_WINDOW ids has its low
    bits zero, no chunk but the last is shorter than CHUNK_MIN, and none is longer than CHUNK_MAX."""
    n = len(ids)
    out: list[int] = []
    begin = 0
    if n > CHUNK_MIN:
        mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        sums = np.cumsum(mixed, dtype=np.uint32)
        rolling = sums[CHUNK_WINDOW - 1 :].copy()
        rolling[1:] -= sums[:-CHUNK_WINDOW]
        rolling ^= rolling >> np.uint32(16)
        for cut in (np.flatnonzero((rolling & np.uint32(CHUNK_MASK)) == 0) + CHUNK_WINDOW).tolist():
            while cut - begin > CHUNK_MAX:
                out.append(CHUNK_MAX)
                begin += CHUNK_MAX
            if cut - begin >= CHUNK_MIN and cut < n:
                out.append(cut - begin)
                begin = cut
    while n - begin > CHUNK_MAX:
        out.append(CHUNK_MAX)
        begin += CHUNK_MAX
    if n > begin:
        out.append(n - begin)
    return out


STAGED = pa.schema([
    ("pack", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk_len", pa.list_(pa.int32())),
    ("chunk_sha", pa.list_(pa.binary())), ("data", pa.binary()),
])
STAGED_DDL = "pack int, doc_id bigint, n_tokens bigint, chunk_len array<int>, chunk_sha array<binary>, data binary"
PACK_DDL = (
    "pack int, doc_id bigint, ord int, start bigint, n_tokens bigint, chunk_sha array<binary>, chunk_len array<int>, "
    "owner array<int>, lent array<boolean>, leaf binary, data binary"
)
PACK = pa.schema([
    ("pack", pa.int32()), ("doc_id", pa.int64()), ("ord", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("chunk_sha", pa.list_(pa.binary())), ("chunk_len", pa.list_(pa.int32())), ("owner", pa.list_(pa.int32())),
    ("lent", pa.list_(pa.bool_())), ("leaf", pa.binary()), ("data", pa.binary()),
])


_ZSTD: dict[str, object] = {}


def _squeeze(data: bytes) -> bytes:
    if "out" not in _ZSTD:
        import zstandard

        _ZSTD["out"] = zstandard.ZstdCompressor(level=3)
    return _ZSTD["out"].compress(data)


def _expand(data: bytes) -> bytes:
    if "in" not in _ZSTD:
        import zstandard

        _ZSTD["in"] = zstandard.ZstdDecompressor()
    return _ZSTD["in"].decompress(data)


def encode_documents(docs: DataFrame, path: str, end_id: int, bounds: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its pack, ids (squeezed), and the lengths and names of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        edges = np.asarray(bounds, dtype=np.int64)
        for piece in textkit.pieces(batches, "text"):
            stream, at = enc.encode(textkit.column(piece, "text"))
            stream = np.insert(stream, at[1:], enc.dtype.type(end_id))
            at = at + np.arange(len(at))
            ids = textkit.column(piece, "doc_id").cast(pa.int64()).to_pylist()
            rows = []
            for i, begin, stop in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = stream[begin:stop]
                data = own.tobytes()
                lengths = chunk_lengths(own)
                at, names = 0, []
                for n in lengths:
                    names.append(_name(data[at : at + n * enc.dtype.itemsize]))
                    at += n * enc.dtype.itemsize
                pack = 0 if i is None else int(np.searchsorted(edges, i, side="right"))
                rows.append((pack, i, len(own), lengths, names, _squeeze(data)))
            yield pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), STAGED, strict=True)], schema=STAGED)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STAGED_DDL)


def pack_bounds(docs: DataFrame, packs: int, doc_id: str = "doc_id") -> list[int]:
    """doc_id values at which the second and later packs begin."""
    share = [k / packs for k in range(1, packs)]
    if not share:
        return []
    found = docs.select(F.percentile_approx(F.col(doc_id).cast("bigint"), share, 10000).alias("q")).first()
    return sorted(set(found.q)) if found and found.q else []


def _write_pack(key: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
    """The rows of one pack in ascending order, each chunk stored once. plan: start, and the shared chunks' first packs."""
    pack = key[0].as_py()
    info = plan.to_pylist()
    start = min((p["start"] for p in info), default=0) or 0
    first = {s: o for p in info for s, o in zip(p["shas"] or [], p["owners"] or [], strict=True)}
    out: list[tuple] = []
    seen: set[bytes] = set()
    kept = [(r["doc_id"] is not None, r["doc_id"] or 0, r["chunk_sha"], r) for r in rows.to_pylist()]
    kept.sort(key=lambda r: r[:3])
    repeated: dict[bytes, int] = {}
    for r in kept:
        for s in r[2]:
            repeated[s] = repeated.get(s, 0) + 1
    for n, (_, _, names, r) in enumerate(kept):
        owner, lent = [], []
        for s in names:
            o = first.get(s, pack)
            owner.append(o if o != pack else -2 if s in seen else -1)
            seen.add(s)
            lent.append(owner[-1] == -1 and (s in first or repeated[s] > 1))
        leaf = hashlib.sha256(b"".join(names)).digest()
        stored = r["data"]
        if any(o != -1 for o in owner):
            data = _expand(stored)
            width = len(data) // r["n_tokens"]
            ends = (np.cumsum(r["chunk_len"]) * width).tolist()
            stored = _squeeze(b"".join(data[e - n * width : e] for e, n, o in zip(ends, r["chunk_len"], owner, strict=True) if o == -1))
        out.append((pack, r["doc_id"], n, start, r["n_tokens"], names, r["chunk_len"], owner, lent, leaf, stored))
        start += r["n_tokens"]
    columns = list(zip(*out, strict=True)) or [[] for _ in PACK]
    return pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, PACK, strict=True)], schema=PACK)


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256 over the leaves; an odd node is carried up."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


MANIFEST_DDL = "pack int, n_docs bigint, n_tokens bigint, start bigint, root binary"
MANIFEST = pa.schema([("pack", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("root", pa.binary())])


def _pack_root(key: tuple, rows: pa.Table) -> pa.Table:
    found = sorted(zip(rows["ord"].to_pylist(), rows["leaf"].to_pylist(), rows["start"].to_pylist(), rows["n_tokens"].to_pylist(), strict=True))
    values = (key[0].as_py(), len(found), sum(f[3] for f in found), found[0][2], merkle([f[1] for f in found]))
    return pa.table([pa.array([v], type=f.type) for v, f in zip(values, MANIFEST, strict=True)], schema=MANIFEST)


def _roots(packs: DataFrame) -> DataFrame:
    return packs.select("pack", "ord", "leaf", "start", "n_tokens").groupBy("pack").applyInArrow(_pack_root, MANIFEST_DDL)


CORPUS_DDL = "n_docs bigint, n_tokens bigint, root binary"


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus row that follows from the manifest, which has a row per pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["pack"])
        whole = (sum(r["n_docs"] for r in rows), sum(r["n_tokens"] for r in rows), merkle([r["root"] for r in rows]))
        yield pa.record_batch([pa.array([v], t) for v, t in zip(whole, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["n_docs", "n_tokens", "root"])

    return spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest").coalesce(1).mapInArrow(run, CORPUS_DDL)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, packs: int | None = None) -> None:
    """Encode docs (doc_id, text) and write the store to folder.

    Ids pass the network once, by pack; of the chunks only names are compared across packs. Packs are runs of doc_id with
    an even share of the documents each, so a chunk that many documents share is one row for each pack; rows that share
    one doc_id, or have none, are one run and stay in one pack, since the store's order keeps them together.
    """
    spark = docs.sparkSession
    packs = packs or 2 * group_count(docs)
    staged_path = f"{folder}/staged"
    encode_documents(docs, tokenizer_path, end_id, pack_bounds(docs, packs)).write.option("compression", "uncompressed").parquet(staged_path)
    staged = spark.read.schema(STAGED_DDL).parquet(staged_path)
    totals = staged.groupBy("pack").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("pack", (F.sum("n").over(Window.orderBy("pack")) - F.col("n")).alias("start"))
    names = staged.select("pack", F.explode(F.array_distinct("chunk_sha")).alias("sha")).distinct()
    shared = names.groupBy("sha").agg(F.min("pack").alias("first"), F.collect_list("pack").alias("in")).where(F.size("in") > 1)
    plan = shared.select("sha", "first", F.explode("in").alias("pack")).groupBy("pack").agg(F.collect_list("sha").alias("shas"), F.collect_list("first").alias("owners"))
    plan = starts.join(plan, "pack", "left").toDF("pack", "start", "shas", "owners")
    staged = spark.read.schema(STAGED_DDL).parquet(staged_path)
    rows = staged.groupBy("pack").cogroup(plan.groupBy("pack")).applyInArrow(_write_pack, PACK_DDL)
    rows.write.partitionBy("pack").option("compression", "uncompressed").parquet(f"{folder}/packs")
    _roots(read_packs(spark, folder)).coalesce(1).write.parquet(f"{folder}/manifest")
    _corpus(spark, folder).write.parquet(f"{folder}/corpus")
    delete(spark, staged_path)


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PACK_DDL).parquet(f"{folder}/packs")


RESULT_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean"
RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("verified", pa.bool_())])


def _rebuild(rows: list[dict], borrowed: dict[bytes, bytes]) -> pa.RecordBatch:
    """Ids of each row from its own chunks and the borrowed ones; verified: every chunk has its name, every recipe its leaf."""
    out: list[tuple] = []
    for r in rows:
        data = _expand(r["data"])
        own = sum(n for n, o in zip(r["chunk_len"], r["owner"], strict=True) if o == -1)
        width = len(data) // own if own else 0
        at, parts, good = 0, [], True
        for s, n, o in zip(r["chunk_sha"], r["chunk_len"], r["owner"], strict=True):
            if o == -1:
                parts.append(data[at : at + n * width])
                at += n * width
            else:
                parts.append(borrowed.get(s, b""))
                width = width or len(parts[-1]) // n
            good = good and _name(parts[-1]) == s
        good = good and hashlib.sha256(b"".join(r["chunk_sha"])).digest() == r["leaf"]
        ids = np.frombuffer(b"".join(parts), dtype="<u2" if width == 2 else "<u4").astype("<u4")
        out.append((r["doc_id"], r["start"], len(ids), zlib.crc32(ids.tobytes()), good and len(ids) == r["n_tokens"]))
    columns = list(zip(*out, strict=True)) or [[] for _ in RESULT]
    return pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Rows that hold all their chunks are read in place. The others (copies) meet the chunks that they borrow pack by pack.
    verified also asks that the pack's Merkle root, made again from the rows, is the manifest's, and the corpus root, made
    again from the manifest, the corpus row's.
    """
    packs = read_packs(spark, folder)
    alone = ~F.exists("owner", lambda o: o != -1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = _rebuild(part.to_pylist(), {})
                yield pa.record_batch([*made.columns, textkit.column(part, "pack")], names=[*made.schema.names, "pack"])

    def join(_key: tuple, rows: pa.Table, chunks: pa.Table) -> pa.Table:
        have = dict(zip(chunks["sha"].to_pylist(), chunks["chunk"].to_pylist(), strict=True))
        made = pa.Table.from_batches([_rebuild(rows.to_pylist(), have)])
        return made.append_column("pack", pa.array([_key[0].as_py()] * made.num_rows, type=pa.int32()))

    def lending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, chunks = [], []
            for r in batch.to_pylist():
                data = _expand(r["data"])
                own = [(s, n, lent) for s, n, o, lent in zip(r["chunk_sha"], r["chunk_len"], r["owner"], r["lent"], strict=True) if o == -1]
                width = len(data) // sum(n for _, n, _ in own)
                at = 0
                for s, n, lent in own:
                    if lent:
                        shas.append(s)
                        chunks.append(data[at : at + n * width])
                    at += n * width
            yield pa.record_batch([pa.array(shas, type=pa.binary()), pa.array(chunks, type=pa.binary())], names=["sha", "chunk"])

    needs = packs.where(~alone)
    refs = read_packs(spark, folder).where(~alone).select("pack", F.explode(F.arrays_zip("chunk_sha", "owner")).alias("c")).where("c.owner <> -1").select("pack", F.col("c.chunk_sha").alias("sha")).distinct()
    lent = packs.where(F.exists("lent", lambda x: x)).select("chunk_sha", "chunk_len", "owner", "lent", "data").mapInArrow(lending, "sha binary, chunk binary")
    chunks = refs.join(lent, "sha").toDF("sha", "pack", "chunk")
    ddl = f"{RESULT_DDL}, pack int"
    columns = ["pack", "doc_id", "start", "n_tokens", "chunk_sha", "chunk_len", "owner", "leaf", "data"]
    here = packs.where(alone).select(columns).mapInArrow(local, ddl)
    there = needs.select(columns).groupBy("pack").cogroup(chunks.groupBy("pack")).applyInArrow(join, ddl)
    manifest = spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest")
    whole = F.broadcast(spark.read.schema(CORPUS_DDL).parquet(f"{folder}/corpus").select(F.col("root").alias("whole")))  # one row
    again = F.broadcast(_corpus(spark, folder).select(F.col("root").alias("again")))
    good = _roots(packs).alias("a").join(manifest.alias("b"), "pack").crossJoin(whole).crossJoin(again)
    good = good.select("pack", F.expr("a.root = b.root AND whole = again").alias("rooted"))
    return here.unionByName(there).join(good, "pack").select("doc_id", "start", "n_tokens", "ids_crc32", F.expr("verified AND rooted").alias("verified"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, stored and read back."""
    import public_tokenizers

    folder = scratch_path(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_store(spark, folder)
