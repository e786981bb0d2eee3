"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over all training texts.  Every batch sends its distinct bigrams
once (hash, count) to the bucket of their hash; a bucket adds them up, writes its sorted
hash array with counts to the shared folder, and names for each bigram one batch as its
owner.  Owners turn distinct bigrams into per-word sums - how many histories a word
follows, and how many words with count one, two, more follow a history - which meet in a
second exchange by word and are written the same way.  No word, however frequent, makes a
large group: a batch contributes one entry to it, and bigrams are dealt by both words.

Scoring sends a batch's distinct words and bigrams to their buckets; the task of a bucket
memory-maps that bucket's arrays alone and answers with counts.  So no machine holds or
reads the whole model, which may be larger than any of them.

p(w|h) = (max(c(hw) - D(c), 0) + g(h) pc(w)) / c(h), with pc(w) the same over continuation
counts, itself interpolated with the uniform 1/(V+1), so unknown words have a share and
the probabilities of the V words and one unknown add up to one.  Discounts come from the
counts of counts.  A history never seen leaves pc(w).

Counts are 64-bit.  The driver is told the length of every array; an array that is missing
or of another length raises, and is never read as unseen words.

Edge cases: a null text is empty and consists of its end; without training texts every
token has probability 1; a null doc_id is a training row; equal ids are separate rows
with equal scores for equal texts; repeated rows count each time; a very long text is a
batch of its own; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P

U64 = np.uint64
START = U64(0x517CC1B727220A95)
END = U64(0x2545F4914F6CDD1D)

#: Bits of a bigram's hash that are kept; two bigrams of a corpus of B distinct ones meet with chance B / 2^48.
KEY_MASK = U64(0xFFFFFFFFFFFF0000)

WORD = np.dtype([("key", "<u8"), ("c", "<u8"), ("cont", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])
_COUNTS = WORD.names[1:]

_SENT = "bucket int, batch long, keys binary, values binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_REPLY = "batch long, bucket int, classes binary"
_REPLY_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("classes", pa.binary())])
_META = "bucket int, sums array<long>"
_META_ARROW = pa.schema([("bucket", pa.int32()), ("sums", pa.list_(pa.int64()))])
_ASK = "bucket int, batch long, words binary, bigrams binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("bigrams", pa.binary())])
_TOLD = "batch long, bucket int, words binary, bigrams binary"
_TOLD_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("bigrams", pa.binary())])

#: Buckets of the second training exchange that carry sums instead of words: counts of counts, and array lengths.
_TALLY, _LENGTHS = -1, -2


class Store:
    """Sorted arrays in a folder that all executors see."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = P.local_path(uri)

    def write(self, name: str, array: np.ndarray) -> None:
        """Whole or not at all, so that a repeated task may write again."""
        temporary = f"{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            array.tofile(f"{self.local}/{temporary}")
            os.replace(f"{self.local}/{temporary}", f"{self.local}/{name}")
            return
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{temporary}") as out:
            out.write(array.tobytes())
        fs.move(f"{root}/{temporary}", f"{root}/{name}")

    def map(self, name: str, dtype, length: int) -> np.ndarray:
        """The array of that length, memory-mapped where the store is a mounted folder."""
        if not length:
            return np.zeros(0, dtype)
        if self.local:
            out = np.memmap(f"{self.local}/{name}", dtype, "r")
        else:
            fs, root = pa.fs.FileSystem.from_uri(self.uri)
            with fs.open_input_file(f"{root}/{name}") as far:
                out = np.frombuffer(far.read(), dtype)
        if len(out) != length:
            raise RuntimeError(f"{self.uri}/{name} holds {len(out)} entries, not {length}")
        return out


def tokens(words: P.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, history, first token of each text) with an end after each text's words."""
    n_docs = len(words.offsets) - 1
    first = words.first + np.arange(n_docs + 1)
    out = np.full(int(first[-1]), END, U64)
    out[np.arange(len(words)) + words.doc_of()] = words.hashes()
    history = np.empty(len(out), U64)
    history[1:] = out[:-1]
    history[first[:-1]] = START
    return out, history, first


def bigrams(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return P.mix(history * U64(P.MULT_B) + P.mix(token)) & KEY_MASK


def _sent(batch: int, buckets: int, keys: np.ndarray, values: np.ndarray):
    cuts = P.bucket_cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        yield {"bucket": int(b), "batch": batch, "keys": P.pack_sorted(keys[lo:hi]), "values": P.pack_counts(values[lo:hi])}


def _discounts(n: list[int]) -> np.ndarray:
    """D(1), D(2), D(3 and more) of counts of counts n1..n4; fixed ones where they are too few."""
    n1, n2, n3, n4 = n
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2
        if n3:
            out[3] = 3 - 4 * y * n4 / n3
    return np.clip(out, 0, [0, 1, 2, 3])


class Model:
    """The place of the arrays and the corpus sums."""

    def __init__(self, uri: str, buckets: int, sums: dict, lengths: dict[int, tuple[int, int, int]]):
        self.uri, self.buckets = uri, buckets
        self.lengths = lengths  # of a bucket's words, bigrams and bigrams of large counts
        self.types, self.total = sums["types"], sums["tokens"]
        self.bigram_d = _discounts(sums["bigram_counts"])
        self.cont_d = _discounts(sums["cont_counts"])
        self.cont_total = sums["cont_total"]
        m1, m2 = sums["cont_counts"][:2]
        self.cont_rest = float(np.dot(self.cont_d[1:], [m1, m2, self.types - m1 - m2]))


def train(docs: DataFrame, train: str = "true", text: str = "text", doc_id: str = "doc_id") -> Model:
    """Count the rows where the SQL condition ``train`` holds (a null holds) and write the model."""
    spark = docs.sparkSession
    uri = P.scratch(spark, "kneser-ney")
    buckets = 2 * P.partitions(spark)
    rows = docs.where(F.coalesce(F.expr(train), F.lit(True)))
    packed = P.pack_documents(rows, text, doc_id)

    def send_bigrams(stream):
        for table in stream:
            for batch in P.batches(table):
                token, history, _ = tokens(batch.words(lower=True))
                keys, counts = np.unique(bigrams(history, token), return_counts=True)
                yield pa.RecordBatch.from_pylist(list(_sent(batch.batch, buckets, keys, counts)), schema=_SENT_ARROW)

    def add_bigrams(table: pa.Table) -> pa.Table:
        """Totals of a bucket: written as arrays, and told as count classes to the owners."""
        sent = sorted(table.to_pylist(), key=lambda r: r["batch"])
        keys = [P.unpack_sorted(r["keys"]) for r in sent]
        counts = np.concatenate([P.unpack_counts(r["values"], len(k), 1)[:, 0] for r, k in zip(sent, keys, strict=True)])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], at)
        b, store = sent[0]["bucket"], Store(uri)
        store.write(f"bigram-{b}.keys", key[order][at].astype("<u8"))
        store.write(f"bigram-{b}.counts", np.minimum(total, 255).astype(np.uint8))
        big = np.flatnonzero(total >= 255)
        store.write(f"bigram-{b}.large", np.stack((big, total[big])).astype("<u8"))
        classes = np.zeros(len(key), np.uint8)
        classes[order[at]] = np.minimum(total, 5)  # the first batch in order owns
        out, begin = [], 0
        for r, k in zip(sent, keys, strict=True):
            out.append({"batch": r["batch"], "bucket": b, "classes": classes[begin : begin + len(k)].tobytes()})
            begin += len(k)
        out.append({"batch": -1 - b, "bucket": b, "classes": np.array([b, len(at), len(big)], "<i8").tobytes()})  # of no batch
        return pa.Table.from_pylist(out, schema=_REPLY_ARROW)

    def send_words(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per word of a batch: count, owned continuations, owned followers by class."""
        out = []
        if not left.num_rows:
            return pa.Table.from_pylist([{"bucket": _LENGTHS, "batch": r["batch"], "keys": b"", "values": r["classes"]} for r in right.to_pylist()], schema=_SENT_ARROW)
        for batch in P.batches(left):
            token, history, first = tokens(batch.words(lower=True))
            replies = sorted(right.to_pylist(), key=lambda r: r["bucket"])
            classes = np.concatenate([np.frombuffer(r["classes"], np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)
            _, at = np.unique(bigrams(history, token), return_index=True)
            owned = classes > 0
            w, h, c = token[at][owned], history[at][owned], classes[owned]
            keys, c_token = np.unique(np.append(token, START), return_counts=True)
            made = np.zeros(len(keys), WORD)
            made["key"], made["c"] = keys, c_token
            made["c"][np.searchsorted(keys, START)] = len(first) - 1
            made["cont"] = np.bincount(np.searchsorted(keys, w), minlength=len(keys))
            slot = np.searchsorted(keys, h)
            for name, mine in (("n1", c == 1), ("n2", c == 2), ("n3", c >= 3)):
                made[name] = np.bincount(slot[mine], minlength=len(keys))
            out += _sent(batch.batch, buckets, keys, np.stack([made[n] for n in _COUNTS], axis=1))
            tally = np.bincount(c, minlength=6)[1:5].astype("<i8")
            out.append({"bucket": _TALLY, "batch": batch.batch, "keys": b"", "values": tally.tobytes()})
        return pa.Table.from_pylist(out, schema=_SENT_ARROW)

    def add_words(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        b = sent[0]["bucket"]
        if b < 0:
            told = [np.frombuffer(r["values"], "<i8") for r in sent]
            return pa.Table.from_pylist([{"bucket": b, "sums": (sum(told) if b == _TALLY else np.concatenate(told)).tolist()}], schema=_META_ARROW)
        keys = [P.unpack_sorted(r["keys"]) for r in sent]
        key = np.concatenate(keys)
        values = np.concatenate([P.unpack_counts(r["values"], len(k), len(_COUNTS)) for r, k in zip(sent, keys, strict=True)])
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at = np.flatnonzero(new)
        made = np.zeros(len(at), WORD)
        made["key"] = key[order][at]
        for i, name in enumerate(_COUNTS):
            made[name] = np.add.reduceat(values[order, i], at)
        Store(uri).write(f"word-{b}", made)
        real = made[made["key"] != START]
        cont = np.bincount(np.minimum(real["cont"], 5).astype(np.int64), minlength=6)[1:5]
        sums = [len(made), len(real), int(real["c"].sum()), int(real["cont"].sum()), *cont.tolist()]
        return pa.Table.from_pylist([{"bucket": b, "sums": sums}], schema=_META_ARROW)

    with P.fleeting_shuffles(spark):  # scoring begins without the exchanges of training
        sent = packed.mapInArrow(send_bigrams, _SENT)
        replies = sent.groupBy("bucket").applyInArrow(add_bigrams, _REPLY)
        words = packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(send_words, _SENT)
        meta = words.groupBy("bucket").applyInArrow(add_words, _META).collect()  # a row a bucket
    n_words = {r.bucket: r.sums[0] for r in meta if r.bucket >= 0}
    told = np.array(next((r.sums for r in meta if r.bucket == _LENGTHS), []), np.int64).reshape(-1, 3)
    n_bigrams = {b: (n, large) for b, n, large in told.tolist()}
    lengths = {b: (n_words.get(b, 0), *n_bigrams.get(b, (0, 0))) for b in n_words.keys() | n_bigrams.keys()}
    parts = [r.sums[1:] for r in meta if r.bucket >= 0]
    types, total, cont_total, *cont = np.sum(parts, axis=0, dtype=np.int64).tolist() if parts else [0] * 7
    tally = next((list(r.sums) for r in meta if r.bucket == _TALLY), [0, 0, 0, 0])
    return Model(uri, buckets, {"types": types, "tokens": total, "cont_total": cont_total, "cont_counts": cont, "bigram_counts": tally}, lengths)


class Bucket:
    """The mapped arrays of one bucket."""

    def __init__(self, model: Model, bucket: int):
        words, bigrams, large = model.lengths.get(bucket, (0, 0, 0))
        store = Store(model.uri)
        self.words = store.map(f"word-{bucket}", WORD, words)
        self.keys = store.map(f"bigram-{bucket}.keys", "<u8", bigrams)
        self.counts = store.map(f"bigram-{bucket}.counts", np.uint8, bigrams)
        self.large = store.map(f"bigram-{bucket}.large", "<u8", 2 * large).reshape(2, -1)

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        """The _COUNTS of ascending words; zeros for those not seen."""
        out = np.zeros((len(keys), len(_COUNTS)), np.int64)
        if len(self.words):
            at = np.searchsorted(self.words["key"], keys)
            at[at == len(self.words)] = 0
            got = self.words[at]
            there = got["key"] == keys
            for i, name in enumerate(_COUNTS):
                out[there, i] = got[name][there]
        return out

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        c = self.counts[at].astype(np.int64)
        many = np.flatnonzero(c == 255)
        c[many] = self.large[1][np.searchsorted(self.large[0], at[many].astype("<u8"))]
        c[self.keys[at] != keys] = 0
        return c


def _score(m: Model, token, history, first, word: np.ndarray, word_of, word_of_history, c: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, base and model log10 probability."""
    at = first[:-1]
    if not len(at):
        return {k: np.zeros(0) for k in ("n_tokens", "n_known", "base_score", "score")}
    count, cont = word[word_of, 0], word[word_of, 1]
    seen, n1, n2, n3 = (word[word_of_history, i] for i in (0, 2, 3, 4))
    uniform = 1.0 / (m.types + 1)
    if m.cont_total:
        lower = (np.maximum(cont - m.cont_d[np.minimum(cont, 3)], 0) + m.cont_rest * uniform) / m.cont_total
    else:
        lower = np.full(len(token), uniform)
    d = m.bigram_d
    rest = d[1] * n1 + d[2] * n2 + d[3] * n3
    p = np.where(seen > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + rest * lower) / np.maximum(seen, 1), lower)
    base = np.log10((count + 1.0) / (m.total + m.types + 1.0))
    return {
        "n_tokens": np.diff(first),
        "n_known": np.add.reduceat((count > 0).astype(np.int64), at),
        "base_score": np.add.reduceat(base, at),
        "score": np.add.reduceat(np.log10(p), at),
    }


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    buckets = model.buckets
    packed = P.pack_documents(docs, text, doc_id)

    def asked(batch: P.Batch):
        """A batch's tokens, and its distinct words and bigrams with the way back to the tokens."""
        token, history, first = tokens(batch.words(lower=True))
        words, back = np.unique(np.concatenate((token, history)), return_inverse=True)
        keys, back_keys = np.unique(bigrams(history, token), return_inverse=True)
        return token, history, first, words, back, keys, back_keys

    def ask(stream):
        for table in stream:
            for batch in P.batches(table):
                _, _, _, words, _, keys, _ = asked(batch)
                w, k = P.bucket_cuts(words, buckets), P.bucket_cuts(keys, buckets)
                both = np.flatnonzero(np.diff(w) + np.diff(k))
                rows = [{"bucket": int(b), "batch": batch.batch, "words": P.pack_sorted(words[w[b] : w[b + 1]]), "bigrams": P.pack_sorted(keys[k[b] : k[b + 1]])} for b in both]
                yield pa.RecordBatch.from_pylist(rows, schema=_ASK_ARROW)

    def tell(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        arrays, out = Bucket(model, rows[0]["bucket"]), []
        for r in rows:
            words, keys = arrays.word_counts(P.unpack_sorted(r["words"])), arrays.bigram_counts(P.unpack_sorted(r["bigrams"]))
            out.append({"batch": r["batch"], "bucket": r["bucket"], "words": P.pack_counts(words) if len(words) else b"", "bigrams": P.pack_counts(keys) if len(keys) else b""})
        return pa.Table.from_pylist(out, schema=_TOLD_ARROW)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for batch in P.batches(left):
            token, history, first, words, back, keys, back_keys = asked(batch)
            w, k = P.bucket_cuts(words, buckets), P.bucket_cuts(keys, buckets)
            record, c = np.zeros((len(words), len(_COUNTS)), np.int64), np.zeros(len(keys), np.int64)
            for r in right.to_pylist():
                b = r["bucket"]
                if r["words"]:
                    record[w[b] : w[b + 1]] = P.unpack_counts(r["words"], w[b + 1] - w[b], len(_COUNTS))
                if r["bigrams"]:
                    c[k[b] : k[b + 1]] = P.unpack_counts(r["bigrams"], k[b + 1] - k[b], 1)[:, 0]
            got = _score(model, token, history, first, record, back[: len(token)], back[len(token) :], c[back_keys])
            n = got["n_tokens"].astype(np.int64)
            tables.append(
                pa.table(
                    [batch.id_column(), pa.array(n), pa.array(got["n_known"].astype(np.int64)), pa.array(np.full(len(n), model.total, np.int64)), pa.array(got["base_score"]), pa.array(got["score"]), pa.array(10 ** (-got["score"] / np.maximum(n, 1)))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )
            )
        return pa.concat_tables(tables)

    told = packed.mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(tell, _TOLD)
    return packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, RESULT)
