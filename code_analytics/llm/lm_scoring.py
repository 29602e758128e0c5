"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the tokens on both sides.

Tokens: the most frequent words are tokens of their own, about as many as the square root of the words of the corpus (a power
of two within TOKENS); the others are hashed into an eighth as many buckets, and a bucket's probability is shared equally among
its words.

Network: the embeddings of the SPAN tokens on each side, scaled by place, are added; after tanh comes a softmax over
classes of tokens and one over the tokens of the class. The classes are CLASSES parts of the tokens in the order of their
counts, with about equal sums of the square roots of the counts. So the probabilities of all tokens add up to one whatever stands around.
It is trained in numpy on all windows of all texts: texts are dealt into ROUNDS shares by their hash; in a round every
task goes through its windows of the share in mini-batches with AdaGrad, beginning with the network of the round before,
and the tasks' changes are averaged, each row of a parameter by how often the tasks used it. The network starts as the
unigram model.

The score is the network's: the log probabilities of all words of a text are added up. The driver and every task hold the
network, whose size is bounded by TOKENS.

Memory, beside the score: of the windows whose hash ends in `memory_bits` zeros (0: of all windows) the words that stand in
them are counted over the whole corpus. In such a window the remembered probability is
(n(window, word) + network) / (n(window) + 1), without the counts of the scored text itself: a text that stands twice in
the corpus is likely by its other copy. Texts are shuffled once, into groups. A window that stands nowhere else changes
nothing, so the groups first exchange the leading PRINT_BITS bits of their windows' hashes, and only windows whose bits came
back as repeated (none that is repeated is left out) are counted with their words. Bits and counts meet by slices of the
hashes, packed as in suffix_dedup; a group is scored when its counts are there. How texts lie in files decides which windows
share a mini-batch, so another layout gives a slightly different network.

Nulls: a null or wordless text has no words, log_prob 0 and a null mean. A null doc_id stays null; repeated rows are
counted and scored each, and are each other's memory. Ties among words at the edge of the vocabulary go by digest. A very
long text is trained and scored in chunks of CHUNK_WORDS words. An empty corpus trains on nothing: all tokens are equally likely.
Columns beside doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, drop_stored, mix, signed, sliced, stored, stored_so_far, table, text_bytes, words
from .suffix_dedup import _entry_table, pack, packed_entries, steps, told_parts, unpack
from .units import column

TOKENS = (2_048, 16_384)
CLASSES = 96
HIDDEN = 16
SPAN = 2
OFFSETS = [o for o in range(-SPAN, SPAN + 1) if o]
ROUNDS = 3
RATE = 0.3
SEED = 1
CHUNK_WORDS = 16_384
#: words that are scored together: fewer calls of numpy than by mini-batches
SCORED_WORDS = 65_536
BLOCK_WORDS = 1_024
PARTIAL_WORDS = 500_000
BLOCK_ROWS = 4096
#: of the windows one in 2^MEMORY_BITS is remembered: all of them
MEMORY_BITS = 0
PRINT_BITS = 40
GROUP_BYTES = 16 << 20
SLICE_TEXT = 64 << 20


def word_counts(docs: DataFrame) -> DataFrame:
    """(word digest, count) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def reduced() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            found, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
            return pa.record_batch([pa.array(signed(found)), pa.array(total)], ["word", "n"])

        for _, data, at in sliced(batches):
            held.append(np.unique(words(data, at)[0], return_counts=True))
            n += len(held[-1][0])
            if n > PARTIAL_WORDS:
                yield reduced()
                held, n = [], 0
        if held:
            yield reduced()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Tokens in the order of their classes: the words of `keys`, the buckets, and last the edge of a text."""

    keys: np.ndarray  # sorted digests of the words that are tokens of their own
    key_token: np.ndarray
    bucket_token: np.ndarray
    log_types: np.ndarray
    first: np.ndarray  # the first token of each class, and behind them the number of tokens

    @property
    def edge(self) -> int:
        return int(self.first[-1])

    @property
    def kind(self) -> np.dtype:
        """Of stored tokens."""
        return np.dtype("<u2" if self.edge < 1 << 16 else "<u4")

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """The token of every word digest."""
        out = self.bucket_token[(codes % U(len(self.bucket_token))).astype(np.int64)]
        if len(self.keys):
            shift, begin, most = self.parts
            where = begin[(codes >> shift).astype(np.int64)]
            for _ in range(most):
                where += self.keys[where] < codes
                np.minimum(where, len(self.keys) - 1, out=where)
            own = np.flatnonzero(self.keys[where] == codes)
            out[own] = self.key_token[where[own]]
        return out

    @cached_property
    def parts(self) -> tuple[np.uint64, np.ndarray, int]:
        """The leading bits of digests to look at by a shift, the first key that has them or larger ones, and how many keys share them at most."""
        bits = max(len(self.keys).bit_length() + 3, 1)
        n = np.bincount((self.keys >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        return U(64 - bits), np.minimum(np.cumsum(n) - n, len(self.keys) - 1), int(n.max())

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, bucket_n: np.ndarray, bucket_types: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
        """From the sorted keys with their counts, and the words and the different words of each bucket; also the weight of each token."""
        weight = np.concatenate([n, bucket_n + 1.0])
        order = np.argsort(-weight, kind="stable")
        token = np.empty(len(order), np.int64)
        token[order] = np.arange(len(order))
        weight = weight[order]
        # of all cuts into so many classes this has the smallest class around a word of the corpus, on average
        root = np.sqrt(weight)
        part = ((np.cumsum(root) - root) / root.sum() * CLASSES).astype(np.int64)
        first = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(order))
        log_types = np.concatenate([np.zeros(len(keys)), np.log(np.maximum(bucket_types, 1))])[order]
        return cls(keys, token[: len(keys)], token[len(keys) :], log_types, first), weight


def vocabulary(counts: DataFrame, max_tokens: int | None = None, n_buckets: int | None = None) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of stored word counts (n_buckets a power of two), and the weights of its tokens."""
    if max_tokens is None:
        n = counts.agg(F.sum("n")).first()[0] or 1
        max_tokens = int(np.clip(1 << round(np.log2(n) / 2), *TOKENS))
    n_buckets = n_buckets or max_tokens // 8
    top = counts.orderBy(F.desc("n"), "word").limit(max_tokens).toArrow()  # at most max_tokens rows
    keys, n = top.column("word").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    # digests are unsigned in numpy and n_buckets is a power of two, so the low bits are the same here
    binned = counts.groupBy(F.col("word").bitwiseAND(F.lit(n_buckets - 1)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    weight, types = np.zeros(n_buckets), np.zeros(n_buckets)
    b = binned.column("b").to_numpy()
    weight[b], types[b] = binned.column("n").to_numpy(), binned.column("types").to_numpy()
    own = (keys % U(n_buckets)).astype(np.int64)
    return Vocabulary.of(keys, n, weight - np.bincount(own, weights=n, minlength=n_buckets), types - np.bincount(own, minlength=n_buckets))


def chunks(values: np.ndarray, upto: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and offsets of rows in chunks of about `size`, or CHUNK_WORDS; a row longer than CHUNK_WORDS is cut, and the parts share no windows."""
    n = np.diff(upto)
    if len(n) and n.max() > CHUNK_WORDS:
        upto = np.unique(np.concatenate([upto, *[np.arange(a, b, CHUNK_WORDS) for a, b in zip(upto[:-1][n > CHUNK_WORDS], upto[1:][n > CHUNK_WORDS], strict=True)]]))
    lo = 0
    while lo < len(upto) - 1:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (size or CHUNK_WORDS), "right")) - 1)
        yield values[upto[lo] : upto[hi]], upto[lo : hi + 1] - upto[lo]
        lo = hi


def by_rows(ufunc: np.ufunc, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """ufunc(x, row) with a short row for all rows of x, many rows side by side: numpy's innermost loop is as long as the last axis."""
    out = np.empty_like(x)
    m = len(x) // 64 * 64
    ufunc(x[:m].reshape(-1, 64 * len(row)), np.tile(row, 64), out=out[:m].reshape(-1, 64 * len(row)))
    ufunc(x[m:], row, out=out[m:])
    return out


class TokenNetwork:
    """Embeddings of the tokens around, scaled by place, tanh, a softmax over the classes and one over the tokens of the class."""

    def __init__(self, vocab: Vocabulary, weight: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = np.float32
        by_class = np.add.reduceat(weight, vocab.first[:-1])
        self.p = [
            r.normal(0, 0.3, (vocab.edge + 1, HIDDEN)).astype(f),
            r.normal(1, 0.3, (len(OFFSETS), HIDDEN)).astype(f),
            np.zeros((1, HIDDEN), f),
            np.zeros((len(by_class), HIDDEN), f),
            np.log(by_class / weight.sum()).astype(f)[:, None],
            np.zeros((vocab.edge, HIDDEN), f),
            np.log(weight / weight.sum()).astype(f)[:, None],
        ]

    @classmethod
    def of(cls, p: list[np.ndarray]) -> TokenNetwork:
        net = cls.__new__(cls)
        net.p = [x.copy() for x in p]
        return net

    def log_probs(self, vocab: Vocabulary, tokens: np.ndarray, upto: np.ndarray, grads: list[np.ndarray] | None = None) -> np.ndarray:
        """The log probability of every token; adds the gradients of their sum to `grads`."""
        if not len(tokens):
            return np.zeros(0)
        embed, scale, bias, w1, b1, w2, b2 = self.p
        n = np.diff(upto)
        # the words of a class stand side by side; 16 bits are sorted by their digits
        order = np.argsort(tokens.astype(np.uint16) if vocab.edge < 1 << 16 else tokens, kind="stable")
        tokens = tokens[order]
        at = (np.arange(len(tokens)) + SPAN * (np.repeat(np.arange(len(n)), n) + 1))[order]
        padded = np.full(len(tokens) + SPAN * (len(n) + 1), vocab.edge)
        padded[at] = tokens
        e = np.take(embed, padded, axis=0)
        # sums over the places around are those of shifted slices, in the order of the text
        inner = len(padded) - 2 * SPAN
        beside = [slice(SPAN + o, SPAN + o + inner) for o in OFFSETS]
        x = by_rows(np.multiply, e[beside[0]], scale[0])
        for k, near in enumerate(beside[1:], 1):
            x += by_rows(np.multiply, e[near], scale[k])
        x = by_rows(np.add, x, bias[0])
        h = np.take(x, at - SPAN, axis=0)
        np.tanh(h, out=h)
        h1 = np.ones((HIDDEN + 1, len(at)), x.dtype)  # with a one for the offset of each logit
        h1[:-1] = h.T  # a column for each word: many classes have few tokens, but all have many words
        wb1, wb2 = np.hstack([w1, b1]), np.hstack([w2, b2])
        # h lies within -1 and 1
        bound1, bound2 = np.abs(wb1).sum(axis=1).max(), np.maximum.reduceat(np.abs(wb2).sum(axis=1), vocab.first[:-1])
        every = np.arange(len(at))
        cut = np.searchsorted(tokens, vocab.first)
        own = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        alone = (np.diff(vocab.first) == 1)[own]
        total = np.where(alone, 0, np.einsum("ij,ij->i", h, np.take(w2, tokens, axis=0)) + b2[tokens, 0]) - vocab.log_types[tokens]
        total += np.einsum("ij,ij->i", h, np.take(w1, own, axis=0)) + b1[own, 0]
        # for the classes and the words within them: sums of exponentials, the logarithm of the factor they lack, and what of their gradient reaches h
        sums, level = np.ones((2, len(at)), h.dtype), np.zeros((2, len(at)), h.dtype)
        ones = np.ones(max(len(wb1), np.diff(vocab.first).max()), h.dtype)
        if grads is not None:
            back, g1, g2 = np.zeros((2, HIDDEN, len(at)), h.dtype), np.zeros_like(wb1), np.zeros_like(wb2)

        def softmax(k: int, a: int, b: int, wb: np.ndarray, here: np.ndarray, bound: float, g: np.ndarray | None) -> None:
            """Words a to b among the rows of wb, of which theirs is `here`; the exponentials stay in the cache."""
            z = wb @ h1[:, a:b]
            if bound > 40:  # logits differ by far less than what float32 holds
                level[k, a:b] = top = z.max()
                z -= top
            np.exp(z, out=z)
            some = np.dot(ones[: len(z)], z, out=sums[k, a:b])
            np.maximum(some, np.float32(1e-30), out=some)
            if grads is not None:
                z.reshape(-1)[here * (b - a) + every[: b - a]] -= some
                np.matmul(wb[:, :-1].T, z, out=back[k, :, a:b])
                g -= z @ (h1[:, a:b] / some).T

        for a in range(0, len(at), BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, len(at))
            softmax(0, a, b, wb1, own[a:b], bound1, grads and g1)
        for c in np.flatnonzero((np.diff(cut) > 0) & (np.diff(vocab.first) > 1)).tolist():
            lo, hi = vocab.first[c], vocab.first[c + 1]
            step = max(BLOCK_WORDS * CLASSES // (hi - lo), BLOCK_WORDS // 16)
            for a in range(cut[c], cut[c + 1], step):
                b = min(a + step, cut[c + 1])
                softmax(1, a, b, wb2[lo:hi], tokens[a:b] - lo, bound2[c], grads and g2[lo:hi])
        total -= (np.log(sums) + level).sum(axis=0)
        if grads is not None:
            for k, g in ((3, g1), (5, g2)):
                grads[k] += g[:, :-1]
                grads[k + 1] += g[:, -1:]
            back /= -sums[:, None]
            dh = back.sum(axis=0)
            np.multiply(h, h, out=h)
            np.subtract(1, h, out=h)
            h *= dh.T
            dx = np.zeros_like(x)
            dx[at - SPAN] = h
            de = np.zeros_like(e)
            for k, near in enumerate(beside):
                grads[1][k] += np.einsum("ij,ij->j", dx, e[near])
                de[near] += by_rows(np.multiply, dx, scale[k])
            grads[2] += np.ones(inner, dx.dtype) @ dx
            first = np.flatnonzero(np.diff(tokens, prepend=-1))
            grads[0][tokens[first]] += np.add.reduceat(de[at], first, axis=0)
            grads[0][vocab.edge] += de[padded == vocab.edge].sum(axis=0)
        result = np.empty(len(tokens))
        result[order] = total
        return result


def coded(docs: DataFrame, vocab) -> DataFrame:
    """The tokens of each text, stored by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in sliced(batches):
            codes, _, _, upto = words(data, at)
            tokens = vocab.value.tokens(codes).astype(vocab.value.kind)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer((upto * tokens.itemsize).astype(np.int64)), pa.py_buffer(tokens)])
            yield pa.record_batch([column(rows, "share"), packed.cast(pa.binary())], ["share", "tokens"])

    share = F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).cast("int")
    return stored(docs.where("text is not null").select(share.alias("share"), "text").mapInArrow(run, "share int, tokens binary"), "share")


CHANGES = "part int, block int, n binary, moved binary"


def trained_share(vocab, params, rate: float = RATE):
    """What a task does in a round: goes through its windows in mini-batches, and gives the changes of each block of rows with their uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, before = TokenNetwork.of(params.value), params.value
        seen = [np.full(x.shape, 0.1, np.float32) for x in before]
        uses = [np.zeros(len(x)) for x in before]
        grads = [np.zeros_like(x) for x in before]
        for batch in batches:
            data, upto = text_bytes(column(batch, "tokens"))
            for tokens, at in chunks(np.frombuffer(data, vocab.value.kind).astype(np.int64), upto // vocab.value.kind.itemsize):
                if not len(tokens):
                    continue
                net.log_probs(vocab.value, tokens, at, grads)
                # of the embeddings those of other tokens stay as they are; the others go block by block, which the cache holds
                embedded = np.append(np.flatnonzero(np.bincount(tokens)), vocab.value.edge)
                blocks = [(k, slice(lo, lo + BLOCK_ROWS)) for k, g in enumerate(grads[1:], 1) for lo in range(0, len(g), BLOCK_ROWS)]
                for k, some in [(0, embedded), *blocks]:
                    g = grads[k][some] * np.float32(1 / len(tokens) ** 0.5)
                    grads[k][some] = 0
                    root = g * g
                    root += seen[k][some]
                    seen[k][some] = root
                    uses[k][some] += np.einsum("ij->i", g != 0)
                    g *= np.float32(rate)
                    g /= np.sqrt(root, out=root)
                    net.p[k][some] += g
        out = []
        for k, (new, old) in enumerate(zip(net.p, before, strict=True)):
            for b, lo in enumerate(range(0, len(new), BLOCK_ROWS)):
                n = uses[k][lo : lo + BLOCK_ROWS]
                if n.any():
                    moved = (new[lo : lo + BLOCK_ROWS] - old[lo : lo + BLOCK_ROWS]).astype(np.float16)
                    out.append((k, b, n.astype(np.uint32).tobytes(), moved.tobytes()))
        part, block, n, moved = zip(*out, strict=True) if out else ((),) * 4
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(n, pa.binary()), pa.array(moved, pa.binary())], ["part", "block", "n", "moved"])

    return run


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each block, every row weighted by its uses; holds the sums of the blocks of its partition."""
    total: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for part, block, n, moved in zip(*(column(batch, c).to_pylist() for c in ("part", "block", "n", "moved")), strict=True):
            n = np.frombuffer(n, np.uint32).astype(np.float64)
            moved = np.frombuffer(moved, np.float16).reshape(len(n), -1) * n[:, None]
            if (part, block) in total:
                total[part, block][0] += n
                total[part, block][1] += moved
            else:
                total[part, block] = [n, moved]
    for (part, block), (n, moved) in total.items():
        mean = (moved / np.maximum(n, 1)[:, None]).astype(np.float32)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([b""], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["part", "block", "n", "moved"])


def trained(docs: DataFrame, max_tokens: int | None = None, n_buckets: int | None = None) -> tuple[Vocabulary, TokenNetwork]:
    """The vocabulary and the network of a corpus."""
    sc = docs.sparkSession.sparkContext
    since = stored_so_far()
    vocab, weight = vocabulary(stored(word_counts(docs)), max_tokens, n_buckets)
    net = TokenNetwork(vocab, weight)
    held = sc.broadcast(vocab)
    texts = coded(docs, held)
    for share in range(ROUNDS):
        params = sc.broadcast(net.p)
        changes = texts.where(F.col("share") == share).select("tokens").mapInArrow(trained_share(held, params), CHANGES)
        # one row for each block: as many floats as the network has
        for r in changes.repartition("part", "block").mapInArrow(averaged, CHANGES).collect():
            mean = np.frombuffer(r["moved"], np.float32).reshape(-1, net.p[r["part"]].shape[1])
            net.p[r["part"]][r["block"] * BLOCK_ROWS : r["block"] * BLOCK_ROWS + len(mean)] += mean
        params.destroy()
    drop_stored(docs.sparkSession, since)
    return vocab, net


WINDOWS = np.dtype([("window", "<u8"), ("word", "<u4"), ("lp", "<f4")])
SCORED = "doc_id long, n_words long, log_prob double, windows binary"


def window_codes(codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A hash of the SPAN words on each side of every word; the word itself is masked."""
    n = np.diff(upto)
    at = np.arange(len(codes)) + SPAN * (np.repeat(np.arange(len(n)), n) + 1)
    padded = np.zeros(len(codes) + SPAN * (len(n) + 1), U)
    padded[at] = codes
    out = np.zeros(len(codes), U)
    for o in OFFSETS:
        out = mix(out + padded[at + o] + U(o + SPAN + 1))
    return out


def network_scores(docs: DataFrame, vocab: Vocabulary, net: TokenNetwork, memory_bits: int = MEMORY_BITS) -> DataFrame:
    """doc_id, n_words, the network's log_prob, and the windows that the memory covers, packed."""
    held = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inner = held.value
        for rows, data, at in sliced(batches):
            codes, _, _, upto = words(data, at)
            tokens = known.tokens(codes)
            each = np.concatenate([np.zeros(0), *[inner.log_probs(known, *c) for c in chunks(tokens, upto)]])
            n = np.diff(upto)
            row = np.repeat(np.arange(rows.num_rows), n)
            total = np.bincount(row, weights=each, minlength=rows.num_rows).astype(np.float64)
            code = window_codes(codes, upto)
            some, window = remembered_windows(code, memory_bits)
            found = np.zeros(len(some), WINDOWS)
            found["window"], found["word"], found["lp"] = window, codes[some] >> U(32), each[some]
            cut = np.searchsorted(row[some], np.arange(rows.num_rows + 1)) if len(some) else np.zeros(rows.num_rows + 1, np.int64)
            packed = [found[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.record_batch([column(rows, "doc_id"), pa.array(n), pa.array(total), pa.array(packed, pa.binary())], ["doc_id", "n_words", "log_prob", "windows"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    out = np.ones(len(sorted_columns[0]), bool)
    out[1:] = False
    for x in sorted_columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _pair_order(window: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by window and then word, words of 32 bits."""
    order = np.argsort(window)
    run = np.cumsum(_begins(window[order]), dtype=np.uint64)
    return order[np.argsort(run << U(32) | word[order])]


def prints(rows: pa.Table, n_slices: int, memory_bits: int) -> pa.Table:
    """The leading bits of the windows of one group, each once."""
    found = []
    for _, data, at in sliced(iter(rows.select(["text"]).combine_chunks().to_batches())):
        codes, _, _, upto = words(data, at)
        found.append(remembered_windows(window_codes(codes, upto), memory_bits)[1] >> U(64 - PRINT_BITS))
    every = np.sort(np.concatenate(found))  # np.unique would hash these
    every = every[_begins(every)]
    if not len(every):
        return _entry_table([])
    part = (every * U(n_slices)) >> U(PRINT_BITS)
    cut = np.flatnonzero(np.diff(part, prepend=U(n_slices)))
    g = rows["g"][0].as_py()
    return _entry_table([(g, int(part[a]), pack(steps(every[a:b]))) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(every)], strict=True)])


def repeated_prints(entries: pa.Table) -> pa.Table:
    """For each entry of one slice a bit: another group has it too."""
    parts = [np.cumsum(unpack(x)[0]) for x in entries["data"].to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every)
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = every[order][1:] == every[order][:-1]
    out = np.empty(len(every), bool)
    out[order] = same[1:] | same[:-1]
    ends = np.cumsum([len(x) for x in parts])[:-1]
    data = [np.array([len(x)], "<u4").tobytes() + np.packbits(x).tobytes() for x in np.split(out, ends)]
    return pa.table([entries["g"], entries["slice"], pa.array(data, pa.binary())], ["g", "slice", "data"])


def _joined_bits(replies: pa.Table) -> np.ndarray:
    """The bits of all slices in their order, a byte each."""
    one = lambda x: np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int(np.frombuffer(x, "<u4", 1)[0]))
    rows = sorted(zip(replies["slice"].to_pylist(), replies["data"].to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.uint8), *[one(x) for _, x in rows]])


def remembered_windows(code: np.ndarray, memory_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and hashes of the windows that the memory covers."""
    if not memory_bits:
        return np.arange(len(code)), code
    some = np.flatnonzero(code & U((1 << memory_bits) - 1) == 0)
    return some, code[some]


def group_windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a group of texts, how many each text has, and the hashes of their windows."""
    codes, n, window = [], [], []
    for _, data, at in sliced(iter(rows.to_batches())):
        c, _, _, upto = words(data, at)
        codes.append(c)
        n.append(np.diff(upto))
        window.append(window_codes(c, upto))
    return np.concatenate(codes), np.concatenate(n), np.concatenate(window)


def _by_lead(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by their leading bits, and these in that order."""
    rest = U(64 - PRINT_BITS)
    if len(window) > 1 << int(rest):
        order = np.argsort(window)
        return order, window[order] >> rest
    # the place in the group takes the bits behind, so values are sorted instead of places
    both = np.sort((window >> rest) << rest | np.arange(len(window), dtype=U))
    return (both & U((1 << int(rest)) - 1)).astype(np.int64), both >> rest


class Remembered:
    """One group of texts, in whatever order; of its windows that may stand elsewhere each (window, word) once, with its count."""

    def __init__(self, rows: pa.Table, bits: np.ndarray, memory_bits: int) -> None:
        self.g = rows["g"][0].as_py()
        self.rows = rows.select(["doc_id", "text"]).combine_chunks()
        self.codes, self.n, window = group_windows(self.rows)
        some, window = remembered_windows(window, memory_bits)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.size = np.bincount(row[some], minlength=len(self.n))
        order, lead = _by_lead(window)
        first = np.flatnonzero(_begins(lead))
        times = np.diff(np.append(first, len(lead)))
        del lead
        order = order[np.repeat(bits[: len(times)].astype(bool) | (times > 1), times)]
        window, some = window[order], some[order]
        word = self.codes[some] >> U(32)
        order = _pair_order(window, word)
        w, x = window[order], word[order]
        #: the places of the words in the order of the entries, their rows, and the entry of each
        self.place = some[order]
        self.row = row[self.place]
        new = _begins(w, x)
        first = np.flatnonzero(new)
        self.windows, self.words = w[first], x[first]
        self.counts = np.diff(np.append(first, len(order)))
        self.entry = np.cumsum(new) - 1

    def entries(self, n_slices: int) -> list[tuple[int, int, bytes]]:
        return packed_entries(self.g, n_slices, 64, self.windows, self.words, self.counts)

    def scores(self, replies: pa.Table, vocab: Vocabulary, net: TokenNetwork) -> pa.Table:
        """The scores of each text, and what the memory changes."""
        each = [np.zeros(0)]
        upto = np.concatenate([[0], np.cumsum(self.n)])
        for tokens, at in chunks(vocab.tokens(self.codes), upto, SCORED_WORDS):
            each.append(net.log_probs(vocab, tokens, at))
        each = np.concatenate(each)
        total = lambda row, v: np.bincount(row, weights=v, minlength=len(self.n)).astype(np.float64)
        network = total(np.repeat(np.arange(len(self.n)), self.n), each)
        same, every = told_parts(replies, 2) if len(self.entry) else (np.zeros(0, U),) * 2
        same, every = same.astype(np.int64)[self.entry], every.astype(np.int64)[self.entry]
        # without the text's own counts
        same -= _own(self.row, self.entry)
        every -= _own(self.row, np.cumsum(np.diff(self.windows, prepend=self.windows[:1]) != 0)[self.entry] if len(self.row) else self.row)
        lp = each[self.place].astype(np.float32).astype(np.float64)
        change = np.log((same + np.exp(lp)) / (every + 1)) - lp
        mean = pa.array(network / np.maximum(self.n, 1), mask=self.n == 0)
        remembered = pa.array(total(self.row, same > 0) / np.maximum(self.size, 1), mask=self.size == 0)
        return pa.table([self.rows["doc_id"], pa.array(self.n), pa.array(network), mean, pa.array(network + total(self.row, change)), remembered], ["doc_id", "n_words", "log_prob", "mean_log_prob", "memory_log_prob", "remembered"])


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry how many of its row have its key."""
    if not len(row):
        return row
    both = row.astype(U) << U(32) | key.astype(U)  # numbers of rows and entries of one group
    order = np.argsort(both)
    first = np.flatnonzero(_begins(both[order]))
    n = np.diff(np.append(first, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(n, n)
    return out


def window_totals(entries: pa.Table) -> pa.Table:
    """Adds up one slice of the window hashes for all groups: for each entry the counts of its (window, word) and of its window.

    Slices below 0 are letters of a group to itself.
    """
    if entries["slice"][0].as_py() < 0:
        return entries.select(["g", "slice", "data"])
    parts = [unpack(x) for x in entries["data"].to_pylist()]
    window = np.concatenate([np.cumsum(p[0]) for p in parts])
    word = np.concatenate([p[1] for p in parts])
    n = np.concatenate([(p[2] + p[3][0] - U(2**63)).view(np.int64) for p in parts])
    order = _pair_order(window, word)
    w, x = window[order], word[order]
    new_window, new = _begins(w), _begins(w, x)
    out = []
    for begins in (new, new_window):
        first = np.flatnonzero(begins)
        sums = np.empty(len(w), np.int64)
        sums[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(w))))
        out.append(np.split(sums, np.cumsum([len(p[0]) for p in parts])[:-1]))
    data = [pack(a, b) for a, b in zip(*out, strict=True)]
    return pa.table([entries["g"], entries["slice"], pa.array(data, pa.binary())], ["g", "slice", "data"])


RESULT = "doc_id long, n_words long, log_prob double, mean_log_prob double, memory_log_prob double, remembered double"


def scored(docs: DataFrame, vocab: Vocabulary, net: TokenNetwork, memory_bits: int = MEMORY_BITS) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob; beside these memory_log_prob, and the share of the remembered windows that other texts hold with the same word."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = total // GROUP_BYTES + 1
    n_slices = max(total // SLICE_TEXT, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = docs.sparkSession.sparkContext.broadcast((vocab, net))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    groups = texts.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups))).repartition("g")
    entries = "g long, slice long, data binary"

    def exact(rows: pa.Table, replies: pa.Table) -> pa.Table:
        bits = _joined_bits(replies)
        # the bits go along as a letter of the group to itself, in a slice of its own
        letter = (group := rows["g"][0].as_py(), -1 - group, np.packbits(bits).tobytes())
        return _entry_table([letter, *Remembered(rows, bits, memory_bits).entries(n_slices)])

    def result(rows: pa.Table, replies: pa.Table) -> pa.Table:
        letter = pc.less(replies["slice"], 0)
        bits = np.unpackbits(np.frombuffer(replies.filter(letter)["data"][0].as_py(), np.uint8))
        return Remembered(rows, bits, memory_bits).scores(replies.filter(pc.invert(letter)), *held.value)

    first = groups.groupBy("g").applyInArrow(lambda t: prints(t, n_slices, memory_bits), entries).groupBy("slice").applyInArrow(repeated_prints, entries)
    counts = groups.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(exact, entries).groupBy("slice").applyInArrow(window_totals, entries)
    return groups.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(result, RESULT)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, *trained(docs))
