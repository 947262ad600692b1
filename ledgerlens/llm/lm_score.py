"""Language-model scores from an Elias-Fano n-gram trie that is dealt to shards.

Texts are packed in blocks of token ids. A block sends each shard its own distinct n-grams of all orders, as sorted
keys with their training counts; a shard sums the counts of all blocks, builds its part of the trie, looks every
asked n-gram up and answers with quantised probabilities. Nothing of the corpus reaches the driver, no part of the
model is sent to every task, and each block moves once. N-grams go to shards by their own hash, so a context with
many successors is spread over all of them, and no n-gram is left out.

A trie level holds contexts, pointers to their successors, and each successor's probability of occurring after that
context among all training tokens. The model smooths with Dirichlet priors: p(w|h) = (P(hw) + m p(w|h')) / (P(h) + m)
with m = prior / N; the lowest order is the smoothed unigram of the base score. A document starts after an end token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import require
from ledgerlens.llm.elias_fano import TrieLevel, count_code, count_of
from ledgerlens.llm.ngram_join import mix

END = np.uint64(0x454E44)
REPLY = "blk long, shard int, body binary, total long, kinds long"
#: Weight of the lower order against counts of the context, for bigrams, trigrams and on.
PRIORS = (1000.0, 10.0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart, as numbers' high bytes are mostly alike."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, ord(a.dtype.char)))], np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist()):
        kind = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, size // kind.itemsize)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, in which they compress."""
    return np.diff(sorted_keys, prepend=np.uint64(0))


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)


def block_rows(folds: int, held: int, block_bytes: int):
    """Blocks of documents: ids, and compressed token ids, lengths, training flags and word hashes. A block's name is the hash of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids, toks, lens, train, size = [], [], [], [], 0

        def flush():
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            body = pack(np.concatenate(toks), np.array(lens, np.int32), np.array(train, np.uint8), np.r_[END, words])
            name = xxhash.xxh3_64_intdigest(f"{part} {made} {ids}".encode() + body) - (1 << 63)
            return pa.record_batch({"blk": pa.array([name], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "body": pa.array([body], pa.binary())})

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
                for w in set(words).difference(known):
                    known[w] = len(known) + 1
                ids.append(i)
                toks.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                toks.append(np.zeros(1, np.uint32))
                lens.append(len(words) + 1)
                train.append(i is None or zlib.crc32(str(i).encode()) % folds != held)
                size += sum(map(len, words)) + len(words)
                if size > block_bytes or len(ids) >= 1 << 20:
                    yield flush()
                    made += 1
                    known.clear()
                    ids, toks, lens, train, size = [], [], [], [], 0
        if ids:
            yield flush()

    return run


class Block:
    """A block's tokens and its distinct n-grams of each order, dealt to shards."""

    def __init__(self, body: bytes, order: int, shards: int, bits: tuple[int, int]):
        self.tok, self.lens, self.train, self.words = unpack(body)
        self.start = np.r_[0, np.cumsum(self.lens)[:-1]]
        self.taught = np.repeat(self.train > 0, self.lens)
        self.order, self.shards, self.bits = order, shards, bits

    def levels(self) -> Iterator[dict]:
        """For each order: every token's n-gram and context by number, and of the n-grams the key, the shard and the order by (shard, key).

        Contexts are numbered as the n-grams of one order below, from 1; 0 is the text's start. A key holds bits of the
        context over those of the successor in it; with the shard that tells n-grams apart. Words have all 64 bits.
        """
        gram, names, before = self.tok, self.words, None
        yield self.dealt(gram, before, names, names)
        for n in range(2, self.order + 1):
            if n == 2:
                before, known = np.r_[np.uint32(0), self.tok[:-1]], names  # the end token is number 0
            else:
                before, known = np.r_[np.uint32(0), gram[:-1] + np.uint32(1)], np.r_[END + np.uint64(n), names]
            before[self.start] = 0
            pair, gram = np.unique(before.astype(np.uint64) << np.uint64(32) | self.tok, return_inverse=True)
            gram = gram.astype(np.uint32)
            ctx = known[(pair >> np.uint64(32)).astype(np.int64)]
            names = mix(ctx + mix(self.words[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]))
            key = mix(ctx) >> np.uint64(64 - self.bits[0]) << np.uint64(self.bits[1]) | names >> np.uint64(64 - self.bits[1])
            yield self.dealt(gram, before, names, key)

    def dealt(self, gram, before, names, key) -> dict:
        to = (names % np.uint64(self.shards)).astype(np.uint16 if self.shards < 65536 else np.uint32)
        by = np.argsort(key)
        by = by[np.argsort(to[by], kind="stable")]
        return {"gram": gram, "before": before, "key": key, "by": by, "cut": np.searchsorted(to[by], np.arange(self.shards + 1))}

    def requests(self) -> Iterator[bytes]:
        """What to ask of each shard: keys and training counts of each order."""
        asked = []
        for g in self.levels():
            own = np.bincount(g["gram"][self.taught], minlength=len(g["key"]))[g["by"]]
            asked.append((g["key"][g["by"]], own, g["cut"]))
        for s in range(self.shards):
            parts = [(key[cut[s] : cut[s + 1]], own[cut[s] : cut[s + 1]]) for key, own, cut in asked]
            yield pack(*(x for key, own in parts for x in (gaps(key), narrow(own))))

    def scores(self, replies: dict[int, bytes], total: int, vocabulary: int, priors: tuple[float, ...]):
        """Known words, base score and model score of every document."""
        answers = {s: unpack(body) for s, body in replies.items()}
        p = count = None
        for n, g in enumerate(self.levels(), 1):
            above = count
            count = np.zeros(len(g["key"]))
            for s, a in answers.items():
                count[g["by"][g["cut"][s] : g["cut"][s + 1]]] = a[n - 1] if n == 1 else count_of(a[n - 1])
            if n == 1:
                first = count[0]  # a start is what follows an end
                known = count[g["gram"]]
                base = p = (known + 0.5) / (total + 0.5 * (vocabulary + 1))
            else:
                prior = priors[min(n, len(priors) + 1) - 2]
                of = (above if n == 2 else np.r_[first, above])[g["before"]]
                p = np.minimum((count[g["gram"]] + prior * p) / (of + prior), 1.0)
        add = lambda x: np.add.reduceat(x, self.start)
        return add((known > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p))


def key_bits(size: int, shards: int) -> tuple[int, int]:
    """Bits of context and successor in a key, so that with the shard an n-gram is taken for another once in millions, on a corpus of ``size`` bytes."""
    bits = min(64, max(40, 22 + max(1, size // 4).bit_length() - shards.bit_length()))
    return max(16, bits - 32), min(32, bits - 16)


def request_rows(order: int, shards: int, bits: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, body in zip(b.column("blk").to_pylist(), b.column("body")):
                asked, first = [], 0
                for s, message in enumerate(Block(body.as_py(), order, shards, bits).requests()):
                    asked.append(message)
                    if len(asked) == 4096 or s + 1 == shards:
                        yield pa.record_batch({"blk": pa.array([blk] * len(asked), pa.int64()), "shard": pa.array(range(first, s + 1), pa.int32()), "body": pa.array(asked, pa.binary())})
                        asked, first = [], s + 1
                pa.default_memory_pool().release_unused()

    return run


def answer_rows(bits: tuple[int, int]):
    """One shard: build its part of the trie from all blocks' counts, and answer each block."""
    low, mask = np.uint64(bits[1]), np.uint64((1 << bits[1]) - 1)

    def run(t: pa.Table) -> pa.Table:
        return answer(t, low, mask)

    return run


def answer(t: pa.Table, low: np.uint64, mask: np.uint64) -> pa.Table:
    asked = [unpack(b.as_py()) for b in t["body"]]
    replies: list[list[np.ndarray]] = [[] for _ in asked]
    total = kinds = 0
    for n in range(1, len(asked[0]) // 2 + 1):
        keys = [np.cumsum(a[2 * n - 2]) for a in asked]
        cut = np.cumsum([0, *map(len, keys)])
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate([a[2 * n - 1] for a in asked]), minlength=len(key)).astype(np.int64)
        if n == 1:
            total, kinds, told = int(count.sum()), int((count > 0).sum()), count
        else:
            seen = count > 0
            trie = TrieLevel(key[seen] >> low, key[seen] & mask, count_code(count[seen]))
            told = trie.lookup(key >> low, key & mask)
        told = told[where]
        for i, r in enumerate(replies):
            part = told[cut[i] : cut[i + 1]]
            r.append(narrow(part) if n == 1 else part)
    pa.default_memory_pool().release_unused()
    return pa.table({
        "blk": t["blk"], "shard": t["shard"], "body": pa.array([pack(*r) for r in replies], pa.binary()),
        "total": pa.array([total] * len(asked), pa.int64()), "kinds": pa.array([kinds] * len(asked), pa.int64()),
    })


def score_rows(order: int, shards: int, bits: tuple[int, int], priors: tuple[float, ...], kind: pa.DataType):
    """A block with all shards' answers to its documents' scores; the shards' totals add up to those of the corpus."""

    def run(_key, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if blocks.num_rows != 1 or replies.num_rows != shards:
            raise RuntimeError(f"{blocks.num_rows} blocks meet {replies.num_rows} of {shards} answers: the documents changed while they were read")
        total, kinds = sum(replies["total"].to_pylist()), sum(replies["kinds"].to_pylist())
        block = Block(blocks["body"][0].as_py(), order, shards, bits)
        known, base, score = block.scores(dict(zip(replies["shard"].to_pylist(), replies["body"].to_pylist())), total, kinds, priors)
        pa.default_memory_pool().release_unused()
        return pa.table({
            "id": pa.array(blocks["ids"][0].as_py(), kind), "held_out": pa.array(block.train == 0), "n_tokens": pa.array(block.lens, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([total] * len(known), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def lm_scores(docs: DataFrame, *, order: int = 3, folds: int = 5, held: int = 1, priors: tuple[float, ...] = PRIORS, shards: int | None = None, shard_bytes: int = 6_000_000, block_bytes: int = 10_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row's whole text.

    Documents whose crc32 of the id as text, modulo ``folds``, is ``held`` teach the model nothing. A null text is
    empty (one end token); a null id is scored, with a null id, and teaches; repeated rows are texts of their own;
    extra columns are ignored; an empty table gives no rows; a text of any length is one block at most. ``docs`` must
    give the same rows in the same order when it is read twice, as files do; a change is noticed and raises an error.

    Blocks and shards follow the corpus: each block sends each shard one message, so both sizes should grow with the
    executors' memory on large corpora (256 MB each at 100 TB makes messages of some hundred n-grams).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(16, -(-size // shard_bytes))
    parts, bits = max(16, -(-size // block_bytes)), key_bits(size, shards)
    blocks = base.mapInArrow(block_rows(folds, held, block_bytes), f"blk long, ids array<{kind.simpleString()}>, body binary").repartition(parts, "blk")
    asked = blocks.mapInArrow(request_rows(order, shards, bits), "blk long, shard int, body binary")
    told = asked.repartition(max(16, shards // 2), "shard").groupBy("shard").applyInArrow(answer_rows(bits), REPLY)
    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = blocks.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(score_rows(order, shards, bits, tuple(priors), to_arrow_type(kind)), schema)
    return out.withColumnRenamed("id", id_col)
