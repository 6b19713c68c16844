"""Scores of texts under a log-bilinear language model, trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fold, lean, stored, text_bytes, words

END = b"\n"  # no word can hold white space
UNK, END_ID, START = 0, 1, 2  # of the model's vocabulary
LEAST_COUNT = 20  # of a word of the model
FEWEST_WORDS = 2045  # of the model: a small corpus has its most frequent words, however rare
MOST_WORDS = (1 << 15) - 3  # of the model, which goes to every task and is normalised over for every token
CONTEXT = 5  # tokens before a word that its probability depends on
DIMS = 8
NOISE = 24
OWN_NOISE = 2  # noise words from the target's class
BLOCK = 1024  # rows of parameters that are averaged together
CHUNK = 512  # tokens scored by one matrix product
SCORED = 1 << 17  # tokens whose classes are scored together
BATCH = 2048
SHARD = 1 << 20  # training tokens that are learned from one start, and as many as PER_WORD for each word of the model
PER_WORD = 32
ROUNDS = 1
RATE = 0.2
DAMPED = 1.0  # squared gradients that a parameter begins with
RUN = 32  # neighbouring targets that are learned in one step
HEAD = 1 << 17  # tokens whose counts every task holds
MOST_COUNTED = 300_000


def token_counts(texts: DataFrame) -> DataFrame:
    """token, c over all rows of column b; words are summed within a task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])
            seen.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words(t))
                seen[END] += 1
                if len(seen) > MOST_COUNTED:
                    yield out()
        if seen:
            yield out()

    return texts.select("b").mapInArrow(lean(count, "b"), "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent tokens, at most that many; of equally frequent ones those whose hashes come first.

    Bands of counts, then counts, then hashes are summed on the cluster until the boundary is found, so that only
    what is taken is collected. What shares the last hash with the boundary (one in 65,536 of a count's tokens) may be left out.
    """
    taken, edge, room = F.lit(False), F.lit(True), most
    for key, down in ((F.floor(F.log2("c") * 16), True), (F.col("c"), True), (F.pmod(F.xxhash64("token"), F.lit(1 << 16)), False)):
        sizes = sorted(((r.k, r.n) for r in counts.where(edge).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=down)
        cut = None
        for k, n in sizes:
            if n > room:
                cut = k
                break
            room -= n
        if cut is None:
            taken = taken | edge
            break
        taken = taken | (edge & ((key > cut) if down else (key < cut)))
        edge = edge & (key == cut)
    return sorted(((bytes(r.token), r.c) for r in counts.where(taken).collect()), key=lambda r: (-r[1], r[0]))


class Model:
    """P(w | the CONTEXT tokens before it), by word classes: P(class of w | context) P(w | class of w, context).

    Log-bilinear: a context is the sum of its tokens' rows of R, each scaled by the weights C of its place. Both
    factors are softmaxes of context . Q[k] + bias[k], the first over all classes, the second over the words of one
    class. Ids below single are classes by themselves; from there on each run of ids is a class. Rows of Q and bias:
    the classes (top of them), then the words from single on. Without a run every word is a class. Untrained, it
    is the unigram model.
    """

    NAMES = ("R", "Q", "C", "bias")

    def __init__(self, size: int, unigram: np.ndarray, seed: int = 1, single: int | None = None, run: int = 1):
        rng = np.random.default_rng(seed)
        self.size, self.single, self.run = size, size if single is None else min(single, size), run
        self.runs = -(-(size - self.single) // run)
        self.top = self.single + self.runs
        tail = unigram[self.single :]
        mass = np.add.reduceat(tail, np.arange(0, len(tail), run)) if len(tail) else tail
        self.R = rng.normal(0, 0.1, (size, DIMS)).astype(np.float32)
        self.Q = np.zeros((size + self.runs, DIMS), np.float32)
        self.C = np.full((CONTEXT, DIMS), 1 / CONTEXT, np.float32)
        self.noise = np.concatenate([unigram[: self.single], mass])
        self.unigram = np.log(np.concatenate([self.noise, tail / np.repeat(mass, run)[: len(tail)]])).astype(np.float32)
        self.bias = self.unigram.copy()

    def get(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in self.NAMES}

    def put(self, parameters: dict[str, np.ndarray]) -> None:
        for n, x in parameters.items():
            setattr(self, n, x.copy())

    def classes(self, w: np.ndarray) -> np.ndarray:
        return np.where(w < self.single, w, self.single + (w - self.single) // self.run)

    def contexts(self, x: np.ndarray) -> np.ndarray:
        """Of runs of ids (their last axis), the contexts of all behind the first CONTEXT of them: shifted sums."""
        e, n = self.R[x[..., :-1]], x.shape[-1] - CONTEXT
        h = e[..., :n, :] * self.C[0]
        for k in range(1, CONTEXT):
            h += e[..., k : k + n, :] * self.C[k]
        return h.reshape(-1, DIMS)

    def learn(self, x: np.ndarray, weight: np.ndarray, state: dict, rng: np.random.Generator) -> None:
        """One step of NCE on runs of ids; AdaGrad. weight: of the targets, which are all ids behind the first
        CONTEXT of a run; 0 for none. Classes have a noise sample shared by the step. Words have as noise the targets that
        happen to stand behind them in a random order of their class: words by their frequency."""
        n = x.shape[1] - CONTEXT
        w, wt = x[:, CONTEXT:].reshape(-1).astype(np.int64), weight.reshape(-1).astype(np.float32)
        h, c = self.contexts(x), self.classes(w)
        z = np.searchsorted(state["cdf"], rng.random(NOISE)).clip(0, self.top - 1)
        # classes
        gp = -wt / (1 + np.exp((h * self.Q[c]).sum(1) + self.bias[c] - state["shift"][c]))
        gn = wt[:, None] / (1 + np.exp(-(h @ self.Q[z].T + (self.bias[z] - state["shift"][z]))))
        dh = gp[:, None] * self.Q[c] + gn @ self.Q[z]
        rows, grads = [c, z], [np.hstack([gp[:, None] * h, gp[:, None]]), np.hstack([gn.T @ h, gn.sum(0)[:, None]])]
        # words of the same class behind each other, in random order
        at = np.flatnonzero((w >= self.single) & (wt > 0))
        at = at[rng.permutation(len(at))]
        at = at[np.argsort((c[at] - self.single).astype(np.uint16 if self.runs < 1 << 16 else np.int64), kind="stable")]
        own, k = h[at], w[at] + self.runs
        q, b, cls, u = self.Q[k], self.bias[k] - state["own"][w[at]], c[at], wt[at]
        near = [np.flatnonzero(cls[s:] == cls[:-s]) for s in range(1, OWN_NOISE + 1)]
        many = np.zeros(len(at), np.float32)
        for y in near:
            many[y] += 1
        shift = np.log(np.maximum(many, 1))
        g = np.where(many > 0, -u / (1 + np.exp((own * q).sum(1) + b - shift)), 0).astype(np.float32)
        dq, do = np.hstack([g[:, None] * own, g[:, None]]), g[:, None] * q
        for s, y in enumerate(near, 1):
            g = u[y] / (1 + np.exp(-((own[y] * q[y + s]).sum(1) + b[y + s] - shift[y])))
            dq[y + s] += np.hstack([g[:, None] * own[y], g[:, None]])
            do[y] += g[:, None] * q[y + s]
        dh[at] += do
        k, g = _summed(np.concatenate([*rows, k]), np.vstack([*grads, dq]))
        e, dh = self.R[x[:, :-1]], dh.reshape(len(x), n, DIMS)
        de, places = np.zeros_like(e), np.empty_like(self.C)
        for i in range(CONTEXT):
            de[:, i : i + n] += dh * self.C[i]
            places[i] = (dh * e[:, i : i + n]).reshape(-1, DIMS).sum(0)
        j, r = _summed(x[:, :-1].reshape(-1), de.reshape(-1, DIMS))
        for name, i, d in (("Q", k, g[:, :-1]), ("bias", k, g[:, -1:]), ("R", j, r), ("C", slice(None), places)):
            p = getattr(self, name)
            if name not in state:
                state[name] = np.full(p.shape, DAMPED, np.float32)
            d = d.reshape(-1) if name == "bias" else d
            state[name][i] += d * d
            p[i] -= np.float32(RATE) * d / np.sqrt(state[name][i])

    def state(self) -> dict[str, np.ndarray]:
        """What learning keeps: of the unigram model the classes' cumulated shares, their logs with the noise's number, and
        the logs of the words' shares of their classes."""
        own = np.zeros(self.size, np.float32)
        own[self.single :] = self.unigram[self.top :]
        return {"cdf": np.cumsum(self.noise), "shift": np.log(NOISE * self.noise).astype(np.float32), "own": own}

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """ln P of all ids of a run behind the first CONTEXT, normalised over all words: over the classes by blocks of
        tokens, over the words class by class."""
        w = x[CONTEXT:].astype(np.int64)
        h, c = np.hstack([self.contexts(x), np.ones((len(w), 1), np.float32)]), self.classes(w)
        q = np.hstack([self.Q, self.bias[:, None]])
        out = np.empty(len(w))
        for k in range(0, len(w), CHUNK):
            out[k : k + CHUNK] = _log_softmax(h[k : k + CHUNK], q[: self.top], c[k : k + CHUNK])
        at = np.flatnonzero(w >= self.single)
        at = at[np.argsort(c[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(c[at])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
            for k in range(lo, hi, CHUNK):
                i = at[k : min(k + CHUNK, hi)]
                first = self.single + (c[i[0]] - self.single) * self.run
                out[i] += _log_softmax(h[i], q[first + self.runs : min(first + self.run, self.size) + self.runs], w[i] - first)
        return out


def _log_softmax(h: np.ndarray, q: np.ndarray, target: np.ndarray) -> np.ndarray:
    s = h @ q.T
    own = s[np.arange(len(s)), target].astype(np.float64)
    with np.errstate(over="ignore", divide="ignore"):
        out = own - np.log(np.exp(s).sum(1))
    if not np.isfinite(out).all():  # too large or too small for exp
        m = s.max(1, keepdims=True)
        out = own - np.log(np.exp(s - m).sum(1, dtype=np.float64)) - m[:, 0]
    return out


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and their rows added up."""
    order = np.argsort(index.astype(np.uint16) if len(index) and index.max() < 1 << 16 else index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def runs(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as runs of RUN targets, each behind its context, and the targets' times; the first CONTEXT ids are no targets."""
    more = -(len(ids) - CONTEXT) % RUN
    ids, times = np.append(ids, np.full(more, START, ids.dtype)), np.append(times[CONTEXT:], np.zeros(more, times.dtype))
    return np.lib.stride_tricks.sliding_window_view(ids, CONTEXT + RUN)[::RUN], times.reshape(-1, RUN)


class _Ids(dict):
    """Ids of known words, and one for all others, which aren't remembered."""

    def __init__(self, ids: dict[bytes, int], other: int):
        super().__init__(ids)
        self.other = other

    def __missing__(self, word: bytes) -> int:
        return self.other

    def of(self, tokens: list[bytes], kind: type) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=kind, count=len(tokens))


def shape(size: int) -> tuple[int, int]:
    """single and run for so many words: about as many classes as words in a class."""
    root = math.isqrt(size)
    return max(64, root // 3), root + 1


_CHANGES = pa.schema([("name", pa.string()), ("block", pa.int64()), ("shard", pa.int64()), ("rows", pa.binary()), ("v", pa.binary()), ("n", pa.float64())])


def _changes(own: Model, start: dict, shard: int, total: int) -> Iterator[pa.RecordBatch]:
    """The rows of each parameter that a shard has changed, BLOCK rows of a parameter in one row."""
    for n in Model.NAMES:
        width = 1 if n == "bias" else DIMS
        moved = (getattr(own, n) - start[n]).reshape(-1, width)
        touched = np.flatnonzero(moved.any(1))
        if not len(touched):
            continue
        moved = moved[touched].astype(np.float16)
        block, first = np.unique(touched // BLOCK, return_index=True)
        ends = [*first[1:], len(touched)]
        cuts = list(zip(first, ends, strict=True))
        cols = [[n] * len(block), block, [shard] * len(block), [touched[i:j].astype(np.int32).tobytes() for i, j in cuts], [moved[i:j].tobytes() for i, j in cuts], [float(total)] * len(block)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CHANGES, strict=True)], schema=_CHANGES)


def _mean(group: pa.Table) -> pa.Table:
    """The mean change of each row of a block over the shards that changed it, by tokens."""
    group = group.sort_by("shard")
    name, block = group["name"][0].as_py(), group["block"][0].as_py()
    width = 1 if name == "bias" else DIMS
    total, weight = np.zeros((BLOCK, width)), np.zeros((BLOCK, 1))
    for r, v, n in zip(group["rows"], group["v"], group["n"], strict=True):
        k = np.frombuffer(r.as_py(), np.int32) - block * BLOCK
        total[k] += n.as_py() * np.frombuffer(v.as_py(), np.float16).reshape(-1, width).astype(np.float64)
        weight[k] += n.as_py()
    k = np.flatnonzero(weight[:, 0])
    return pa.table({"name": [name], "rows": pa.array([(k + block * BLOCK).astype(np.int32).tobytes()], pa.binary()), "v": pa.array([(total[k] / weight[k]).astype(np.float32).tobytes()], pa.binary())})


def _numbered(texts: DataFrame, vocabulary: dict[bytes, int], shards: int) -> DataFrame:
    """shard, h, times and ids (32-bit) of the training texts; equal rows of a slice are one, with their number."""
    names = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(names.value, UNK)
        for b in batches:
            rows: Counter = Counter(zip(b.column("h").to_pylist(), b.column("b").to_pylist(), strict=True))
            ids = [known.of([*words(t), END], np.int32).tobytes() for _, t in rows]
            h = np.array([k for k, _ in rows], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h % shards), pa.array(h), pa.array(list(rows.values()), pa.int64()), pa.array(ids, pa.binary())], names=["shard", "h", "times", "ids"])

    rows = texts.select(F.xxhash64("doc_id", "b").alias("h"), "b")
    return rows.mapInArrow(lean(number, "b"), "shard bigint, h bigint, times bigint, ids binary")


def trained(texts: DataFrame, vocabulary: dict[bytes, int], unigram: np.ndarray, tokens: int, rounds: int = ROUNDS) -> Model:
    """Each round, every shard of the texts is gone over once from the same start; a parameter's changes are averaged
    by tokens over the shards that changed it.

    Texts are dealt to shards by their hash and come in its order, so the model doesn't depend on partitions. A shard
    has as many tokens for each word of the model, whatever the corpus, so that what the shards send stays in
    proportion to it. The averages are formed by blocks of parameters on the cluster; the driver gets one model.
    """
    spark, form = texts.sparkSession, shape(len(unigram))
    model = Model(len(unigram), unigram, 1, *form)
    if not tokens:
        return model
    train = stored(_numbered(texts, vocabulary, max(1, round(tokens / max(SHARD, PER_WORD * len(unigram))))), "numbered")
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((model.get(), unigram, turn))

        def learn(rows: pa.Table) -> pa.Table:  # runs before the next turn
            start, uni, turn = sent.value
            shard = rows["shard"][0].as_py()
            rows = rows.group_by(["h", "ids"]).aggregate([("times", "sum")]).sort_by([("h", "ascending"), ("ids", "ascending")])
            own = Model(len(uni), uni, 1, *form)
            own.put(start)
            state, rng = own.state(), np.random.default_rng([turn, shard])
            parts = [np.concatenate([np.full(CONTEXT, START, np.int32), np.frombuffer(x.as_py(), np.int32)]) for x in rows["ids"]]
            ids, times = np.concatenate(parts), np.repeat(rows["times_sum"].to_numpy(), [len(p) for p in parts])
            times = np.where(ids == START, 0, times)
            x, times = runs(ids, times)
            for k in np.array_split(rng.permutation(len(x)), max(1, len(x) * RUN // BATCH)):
                own.learn(x[k], times[k], state, rng)
            return pa.Table.from_batches(list(_changes(own, start, shard, int(times.sum()))), _CHANGES)

        moved = train.groupBy("shard").applyInArrow(learn, "name string, block bigint, shard bigint, rows binary, v binary, n double")
        for r in moved.groupBy("name", "block").applyInArrow(_mean, "name string, rows binary, v binary").collect():
            p = getattr(model, r.name)
            k = np.frombuffer(r.rows, np.int32)
            p[k] += np.frombuffer(r.v, np.float32).reshape(len(k), *p.shape[1:])
        sent.unpersist()
    dropped(train)
    return model


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Training texts are those outside the held-out fold. The model's words are all with LEAST_COUNT
    occurrences, so that they grow with the corpus, and the FEWEST_WORDS most frequent; above MOST_WORDS the most
    frequent of them. Any other token is its unknown word, times the token's add-one share among the tokens that
    aren't words of the model, so that all tokens have positive probabilities that sum to 1. Counts are of all training
    texts: those of the most frequent tokens go to every task, the others are joined by token. A null text is empty:
    its only token is the end. A null doc_id trains. Repeated rows stay and all train; other columns are not read;
    without training texts every count is 0 and base_score is 0; an empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", fold("doc_id", 7, 2).alias("held_out"), text_bytes().alias("b"))
    train = rows.where(~F.col("held_out"))
    counts = stored(token_counts(train), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    seen = dict(frequent(counts, HEAD)) | dict(frequent(counts.where(F.col("c") >= LEAST_COUNT), MOST_WORDS))
    head = sorted(seen.items(), key=lambda r: (-r[1], r[0]))
    model_words = [(w, c) for k, (w, c) in enumerate(r for r in head if r[0] != END) if (c >= LEAST_COUNT and k < MOST_WORDS) or k < FEWEST_WORDS]
    vocabulary = {w: k + 3 for k, (w, _) in enumerate(model_words)} | {END: END_ID}
    ends = seen.get(END, 0)
    unknown = n - ends - sum(c for _, c in model_words)
    unigram = np.array([unknown + 1, ends + 1, 1, *(c for _, c in model_words)], dtype=np.float64)
    model = trained(train.select("doc_id", "b"), vocabulary, unigram / unigram.sum(), n)
    # of the unknown word's tokens
    rest = unknown + v - len(model_words) - (ends > 0) + 1
    table = {w: (vocabulary.get(w, UNK), c) for w, c in head} | ({} if ends else {END: (END_ID, 0)})
    sent = spark.sparkContext.broadcast((model, table))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value
        index = _Ids({w: k for k, w in enumerate(known)}, len(known))
        ids = np.array([i for i, _ in known.values()] + [UNK], dtype=np.int64)
        logs = np.array([math.log10(c + 1) for _, c in known.values()] + [0.0])
        some = np.array([c > 0 for _, c in known.values()] + [False])
        last = len(known)
        # per token: ln P of the model for its id, and of the unknown word's tokens log10 of their share
        share = np.where(ids == UNK, logs, 0.0)
        for b in batches:
            out = [[] for _ in range(5)]
            lists, tokens, times = [0], [], []
            waiting, held = [], 0

            def flush() -> None:
                p = own.log_p(np.concatenate(waiting))
                # of each text without its START ids; the first of them is before the run
                ends = np.cumsum([len(z) for z in waiting]) - CONTEXT
                sums = np.array([p[a - len(z) + CONTEXT : a].sum() for a, z in zip(ends, waiting, strict=True)]) / math.log(10)
                for j, v in enumerate(sums, len(out[3]) - len(waiting)):
                    out[3][j] += float(v)
                waiting.clear()

            for t in b.column("b").to_pylist():
                w = words(t)
                w.append(END)
                k = index.of(w, np.int64)
                z = ids[k]
                tail = Counter(w[j] for j in np.flatnonzero(k == last))
                out[0].append(len(w))
                out[1].append(int(some[k].sum()))
                out[2].append(float(logs[k].sum()))
                out[3].append(float(share[k].sum()))
                out[4].append(int((z == UNK).sum()))
                tokens += tail
                times += tail.values()
                lists.append(len(tokens))
                waiting.append(np.concatenate([np.full(CONTEXT, START), z]))
                held += len(z)
                if held >= SCORED:
                    flush()
                    held = 0
            if waiting:
                flush()
            pair = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], names=["token", "times"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pair)],
                names=["doc_id", "held_out", "n_tokens", "known", "logs", "lm", "unknown", "tail"],
            )

    scored = rows.mapInArrow(lean(score, "b"), "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, lm double, unknown bigint, tail array<struct<token: binary, times: bigint>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.inline("tail")).join(counts, "token")
    sums = tail.groupBy("row").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("l"))
    logs = F.coalesce("l", F.lit(0.0))
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("lm") + logs - F.col("unknown") * math.log10(rest)).alias("score"),
    )
