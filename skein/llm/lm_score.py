"""Document log-likelihood under a gated recurrent language model and a unigram base.

Tokens are words (A-Z lower-cased) and one end of each text.  Training texts are
those whose crc32(doc_id as text) modulo 7 is not 2.

* Counts: the exact count of every training word, over all training texts.
* Base: sum of log10((c + 1) / (N + V + 1)) over a text's tokens.
* Model: the recurrent network chooses a class, and within the class a member, by
  a softmax each.  Members are the ``HEAD`` most frequent words, and ``TAILS``
  leaves that hold all other words: words of one class of leaves have an ending,
  those of one leaf also a beginning in common (hashed).  A word of a leaf has the
  leaf's probability times (c + 1) / (sum of c + 1 over the leaf, and 1 for unseen
  words), so the probabilities of all words, known ones and an unseen one in each
  leaf, sum to one.  Each text is scored whole, with the state carried from window
  to window.

Network weights are learned on all training texts.  They begin with what whole
texts of a hashed sample (``warm_docs``, ``warm_tokens``) teach; then each of
``ROUNDS`` hashed shares of all texts is learned in its partitions, and the weights
of the partitions are averaged by their tokens.  Counts of the
``FREQUENT`` most frequent words (12 bytes each) are broadcast, all others meet
their words in a shuffle.

Null texts count as empty: their only token is the end.  Repeated rows are
counted and scored one by one; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import gru
from skein.llm.common import bounded_batches, cut, first_by_hash, most_frequent, tasks_for, texts, tidy
from skein.llm.hashed import remainder
from skein.llm.textops import by_size, hash_spans, lowered, mix, text_bytes, word_spans

HEAD = 1024
TAILS = 512  # 16 classes by ending, 32 leaves each by beginning
WIDTH = 24
FREQUENT = 1 << 18
WARM_DOCS = 2000
WARM_TOKENS = 1_200_000
MET = 2_000_000  # rare words that a task looks up
ROUNDS = 2
RATE = 0.005  # of the rounds
STREAMS = 256
SUMS = 8  # partial sums of weights that reach the driver
END_KEY = np.uint64(1)
COUNTED = 5_000_000  # tokens counted together in a worker
LEARNED = 340_000  # tokens learned together in a worker
SCORED = 3_000_000  # tokens scored together in a worker
ENTRY = np.dtype([("word", "<u8"), ("row", "<i8")])


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and leaves of tail classes with an end behind each text, and the row pointer."""
    raw, offs = text_bytes(col)
    low = lowered(raw)
    s, e, ptr = word_spans(low, offs)
    h = hash_spans(low, s, e)
    ending, start = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    for k in (1, 2, 3):
        at = e - k
        ending = ending * np.uint64(257) + np.where(at >= s, low[np.maximum(at, 0)], 0).astype(np.uint64)
    for k in (0, 1):
        start = start * np.uint64(257) + np.where(s + k < e, low[s + k], 0).astype(np.uint64)
    group = np.uint64(gru.GROUP)
    tail = ((mix(ending) % np.uint64(TAILS // gru.GROUP)) * group + mix(start) % group).astype(np.int64)
    docs = len(ptr) - 1
    spot = np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(ptr))
    out_ptr = ptr + np.arange(docs + 1)
    words, tails = np.full(len(h) + docs, END_KEY, np.uint64), np.zeros(len(h) + docs, np.int64)
    words[spot], tails[spot] = h, tail
    return words, tails, out_ptr


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        w, t = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        keys, first, n = np.unique(w, return_index=True, return_counts=True)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(t[first].astype(np.int32)), pa.array(n)], ["word", "tail", "c"])

    for b in by_size(batches, "text", 2 << 20):
        w, t, _ = tokens(b.column(0))
        held.append((w, t))
        if sum(len(h[0]) for h in held) > COUNTED:
            yield flush()
            held.clear()
    if held:
        yield flush()


class Lexicon:
    """Frequent words with counts, head ids, and the mass of each tail class."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> None:
        """``words`` by falling count; ``mass`` the sum of c + 1 of all words by tail class, head words left out, plus 1."""
        ids = np.full(len(words), -1, np.int32)
        ids[:HEAD] = np.arange(min(HEAD, len(words)))
        order = np.argsort(words)
        self.words, self.counts, self.ids, self.mass = words[order], counts[order], ids[order], mass
        # hashes are even, so a few bits lead close to a word's place: cheaper than halving the whole table for each token
        self.shift = np.uint64(64 - max(1, len(words).bit_length()))
        self.first = np.searchsorted(self.words, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, w: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 if not among the frequent words; id) of each word."""
        if not len(self.words):
            return np.full(len(w), -1, np.int64), HEAD + tail
        last = len(self.words) - 1
        spot = np.minimum(self.first[(w >> self.shift).view(np.int64)], last)
        live = np.flatnonzero(self.words[spot] < w)
        while len(live):
            live = live[spot[live] < last]
            spot[live] += 1
            live = live[self.words[spot[live]] < w[live]]
        here = self.words[spot] == w
        ids = np.where(here, self.ids[spot], -1)
        return np.where(here, self.counts[spot], -1), np.where(ids >= 0, ids, HEAD + tail).astype(np.int64)


def _encode(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", 2 << 20):
            w, t, ptr = tokens(b.column(1))
            _, ids = lexicon.find(w, t)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def _warm(epochs: int):
    """The weights that all texts of a partition teach a fresh network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = [np.asarray(ids.values, np.int64) for b in batches for ids in b.column(0)]
        yield pa.record_batch([pa.array([gru.fit(gru.create(HEAD + TAILS, 0, WIDTH), streams, epochs=epochs).packed().tobytes()], pa.binary())], ["block"])

    return run


def _warmed(training: DataFrame, lexicon: Lexicon, epochs: int, docs: int, most: int) -> gru.Gru:
    """A network taught by at most ``docs`` texts and ``most`` tokens, chosen by a hash of the doc_id, in one task; only weights and sizes reach the driver."""
    chosen = first_by_hash(training.select("doc_id").where("doc_id is not null").distinct(), docs)
    one = training.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    sample = one.mapInArrow(_encode(lexicon), "doc_id long, ids array<int>").where(F.size("ids") <= most // 16)  # no text makes up the sample alone
    sample = cut(sample.withColumn("spot", F.xxhash64("doc_id")), "warm")
    sizes = sample.select("spot", "doc_id", F.size("ids").alias("n")).toArrow().sort_by([("spot", "ascending"), ("doc_id", "ascending")])
    n = int((np.cumsum(sizes["n"].to_numpy()) <= most).sum())
    if not n:
        return gru.create(HEAD + TAILS, 0, WIDTH)
    last = sizes.slice(n - 1, 1).to_pylist()[0]
    place = F.struct(F.lit(last["spot"]).cast("long").alias("spot"), F.lit(last["doc_id"]).cast("long").alias("doc_id"))
    rows = sample.where(F.struct("spot", "doc_id") <= place).coalesce(1).sortWithinPartitions("spot", "doc_id").select("ids")
    block = rows.mapInArrow(_warm(epochs), "block binary").first()["block"]
    return gru.create(HEAD + TAILS, 0, WIDTH).unpacked(np.frombuffer(block, "<f4"))


def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ones, and the row pointer."""
    raw, offs = text_bytes(col)
    return raw.view("<u2").astype(np.int32), offs // 2


def _learn(model: gru.Gru):
    """(tokens, weights) of a partition that goes on from the given weights over all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = model.unpacked(model.packed()), 0
        for b in by_size(batches, "ids", 2 * LEARNED):
            ids, ptr = _ids(b.column(0))
            gru.fit(own, np.split(ids, ptr[1:-1]), streams=STREAMS, epochs=1, rate=RATE)
            n += len(ids)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([own.packed().tobytes()], pa.binary())], ["n", "block"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tokens, sum of weights times tokens) of a partition."""
    n, total = 0, None
    for b in batches:
        for k, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = np.frombuffer(block, "<f4").astype(np.float64) * k
            n, total = n + k, own if total is None else total + own
    if n:
        yield pa.record_batch([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "block"])


def learned(training: DataFrame, lexicon: Lexicon, model: gru.Gru) -> tuple[gru.Gru, int]:
    """The model after all training texts (share, ids of ``lexicon``), each once, and how many tokens it has learned from."""
    seen = 0
    for r in range(ROUNDS):
        share = training.where(F.col("share") == r).select("ids")
        parts = cut(share.mapInArrow(_learn(model), "n long, block binary"), "weights")
        sums = parts.coalesce(SUMS).mapInArrow(_sums, "n long, block binary").toArrow()
        n = sum(sums["n"].to_pylist())
        if n:
            model = model.unpacked(sum(np.frombuffer(x, "<f8") for x in sums["block"].to_pylist()) / n)
        seen += n
    return model, seen


def _encoded(lexicon: Lexicon, buckets: int, unit: float):
    """Rows (0, row, doc_id, share, tokens, known, base, the part of the score that no network gives, ids) with all but rare words, and blocks of rare words (1, bucket, ...)."""
    schema = ["kind", "row", "doc_id", "share", "n_tokens", "n_known", "base", "rest", "ids", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", 4 << 20):
            w, t, ptr = tokens(b.column(3))
            count, ids = lexicon.find(w, t)
            doc = np.repeat(np.arange(b.num_rows), np.diff(ptr))
            seen = count >= 0
            known = np.where(seen, np.log10(np.maximum(count, 0) + 1.0), 0.0)
            base = np.bincount(doc, known, b.num_rows) - np.diff(ptr) * unit
            in_tail = ids >= HEAD
            tail_part = np.where(in_tail, known - np.log10(lexicon.mass[np.where(in_tail, ids - HEAD, 0)]), 0.0)
            n = b.num_rows
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ptr * 2).astype("<i4")), pa.py_buffer(ids.astype("<u2"))])
            facts = [pa.array(np.diff(ptr)), pa.array(np.bincount(doc, seen, n).astype(np.int64)), pa.array(base), pa.array(np.bincount(doc, tail_part, n))]
            yield pa.record_batch([pa.array(np.zeros(n, np.int32)), b.column(0), b.column(1), b.column(2), *facts, packed, pa.nulls(n, pa.binary())], schema)
            rare = np.flatnonzero(~seen)
            if len(rare):
                e = np.empty(len(rare), ENTRY)
                e["word"], e["row"] = w[rare], b.column(0).to_numpy(zero_copy_only=False)[doc[rare]]
                bucket = (mix(e["word"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = [*edge[1:].tolist(), len(bucket)]
                k = len(edge)
                none, real = pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64())
                yield pa.record_batch([pa.array(np.ones(k, np.int32)), pa.array(bucket[edge]), none, pa.nulls(k, pa.int32()), none, none, real, real, pa.nulls(k, pa.binary()), pa.array([e[a:z].tobytes() for a, z in zip(edge.tolist(), ends)], pa.binary())], schema)

    return run


def _score(model: gru.Gru):
    """(row, doc_id, n_tokens, n_known, base, score) from encoded rows; many texts go together, as the longest one decides how many steps are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "ids", 2 * SCORED):
            score = model.score(*_ids(b.column(6))) / np.log(10) + b.column(5).to_numpy()
            yield pa.record_batch([*b.columns[:5], pa.array(score)], [*b.schema.names[:5], "score"])

    return run


def _count_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            bucket = (mix(w.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            both, bucket = np.stack([w, c], 1)[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = [*edge[1:].tolist(), len(bucket)]
            yield pa.record_batch([pa.array(np.full(len(edge), 2, np.int32)), pa.array(bucket[edge]), pa.array([both[a:z].tobytes() for a, z in zip(edge.tolist(), ends)], pa.binary())], ["kind", "bucket", "block"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, log count, known) sums of the rare words of each row, from blocks of one bucket range."""
    asked, known = [], []
    for b in batches:
        for kind, block in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            (known if kind == 2 else asked).append(block)
    if not asked:
        return
    e = np.concatenate([np.frombuffer(x, ENTRY) for x in asked])
    table = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in known]) if known else np.zeros((0, 2), np.int64)
    words = table[:, 0].view(np.uint64) if len(table) else np.zeros(0, np.uint64)
    order = np.argsort(words)
    words, counts = words[order], table[order, 1]
    c = np.zeros(len(e), np.int64)
    if len(words):
        spot = np.minimum(np.searchsorted(words, e["word"]), len(words) - 1)
        c = np.where(words[spot] == e["word"], counts[spot], 0)
    rows, at = np.unique(e["row"], return_inverse=True)
    yield pa.record_batch([pa.array(rows), pa.array(np.bincount(at, np.log10(c + 1.0), len(rows))), pa.array(np.bincount(at, c > 0, len(rows)).astype(np.int64))], ["row", "more", "k"])


@tidy
def lm_scores(docs: DataFrame, epochs: int = 2, warm_docs: int = WARM_DOCS, warm_tokens: int = WARM_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = texts(docs)
    training = rows.where(F.coalesce(remainder(7), F.lit(0)) != 2)
    counts = cut(training.select("text").mapInArrow(_count, "word long, tail int, c long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")), "counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(size[0]), int(size[1])
    top = most_frequent(counts, "c", FREQUENT).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, tail, c = top["word"].to_numpy().view(np.uint64), top["tail"].to_numpy(), top["c"].to_numpy()
    if len(words) and END_KEY not in words[:HEAD]:  # the end is always a head word
        k = np.flatnonzero(words == END_KEY)
        front = np.concatenate([k, np.delete(np.arange(len(words)), k)]) if len(k) else np.arange(len(words))
        words, tail, c = words[front], tail[front], c[front]
    mass = np.ones(TAILS)
    for r in counts.groupBy("tail").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["tail"]] += r["m"]
    np.subtract.at(mass, tail[:HEAD], c[:HEAD] + 1)
    lexicon = Lexicon(words, c, mass)
    # tokens that are none of the frequent words, in all texts, as training texts are six of seven
    rare = int(size[0]) - int(c.sum()) + distinct
    n = tasks_for(spark, rare * 7 // 6 + distinct, MET)
    share = F.when(F.coalesce(remainder(7), F.lit(0)) != 2, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))).cast("int")  # null: held out
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", share.alias("share"), "text")
    unit = float(np.log10(total + distinct + 1))
    # texts are cut into words once for counts and once for all that follows
    found = cut(numbered.mapInArrow(_encoded(lexicon, 4 * n, unit), "kind int, row long, doc_id long, share int, n_tokens long, n_known long, base double, rest double, ids binary, block binary"), "encoded")
    model = _warmed(training, lexicon, epochs, warm_docs, warm_tokens)
    model, _ = learned(found.where("kind = 0 and share is not null").select("share", "ids"), lexicon, model)
    whole = found.where("kind = 0").select("row", "doc_id", "n_tokens", "n_known", "base", "rest", "ids")
    scored = cut(whole.mapInArrow(_score(model), "row long, doc_id long, n_tokens long, n_known long, base double, score double"), "scores")
    asked = found.where("kind = 1").select("kind", F.col("row").alias("bucket"), "block")
    table = counts.select("word", "c").mapInArrow(_count_blocks(4 * n), "kind int, bucket long, block binary")
    met = asked.unionByName(table).repartition(n, "bucket").mapInArrow(_meet, "row long, more double, k long")
    met = met.groupBy("row").agg(F.sum("more").alias("more"), F.sum("k").alias("k"))
    main = scored.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return main.select(
        "doc_id",
        F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
