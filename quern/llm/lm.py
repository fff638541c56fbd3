"""LM scoring with a causal self-attention model in numpy, and what the whole corpus said after the same two words.

The attention model reads subword ids and predicts each id from the ids before it in a window, in two steps: the id's
class, by a softmax over classes and a little of the classes' counts, and the id in its class, by the add-one counts of
all training documents. Classes part
ids by whether they start a word, by the company they keep and by frequency. Windows overlap, and each id is scored once,
with masked attention over a batch of windows. An id's factor says whether a word goes on or ends, so that the factors of
a word's ids and of its end make up the word's probability.

That probability is where a second-order model of words backs off to: P(w | u v) = max(c(uvw) - D, 0) / c(uv) +
D t(uv) / c(uv) * P(w | window), with counts c and numbers t of different words after u v over all training documents, and
D = n1 / (n1 + 2 n2) from their counts of counts. Where u v was never seen, the attention model stands alone.

The fit takes in every training document: counts, classes and gradient steps all of its ids, each as the target of one
window. A start, fitted on the windows of some batches, is where every shard of windows sets out; each shard moves it by one
pass over its windows, and the moves are averaged, by windows and for an id's own vector by the id's occurrences.

Documents travel in batches. Words and their contexts are counted by hash (96 bits for words, 64 for contexts and 24 more
for what follows): a batch sends each different one once to its bucket, and gets the corpus's counts back, so that a
frequent word costs a bucket one entry a batch.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import TOKENIZER, Encoder, batches, gathered, materialise

HELD_OUT, FOLDS = 2, 7
DIM = 16
WINDOW = 16
STRIDE = 12
#: Ids of a training document that one window of the fit stands for: all of them are its targets.
SPAN = WINDOW
#: Windows of a shard, about.
SHARD_WINDOWS = 500_000
#: Most frequent ids whose company is counted.
COMPANY = 128
#: Blocks of ids in which tasks add up their company.
COMPANY_BLOCKS = 16
#: Weight of the classes' counts beside the softmax: classes of ids that no training document has are not ruled out.
PRIOR = 0.02
GROUPS = 6
START_BINS, GO_BINS = 8, 4
STEPS = 700
BATCH = 128
#: Windows that are scored at once.
CHUNK = 512
#: Windows of a step, and the highest rate, of the pass over a shard.
PASS_BATCH = 512
PASS_RATE = 0.005
#: Places whose classes are held at once in a step.
PLACES = 2048
#: Bytes of text of a batch, and different keys of a bucket, about.
BATCH_BYTES = 6 << 20
KEYS = 1_000_000
#: The end of a document among words: it holds a space, so that no word equals it.
END = " "
#: Words whose ids a worker keeps.
KNOWN = 600_000
_U = np.uint64


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Pieces:
    """Subword ids of single words. A word is encoded with a space before it; the end is one id of its own. The last KNOWN
    words, about, are looked up instead of encoded again."""

    _made: dict[str, Pieces] = {}

    @classmethod
    def get(cls, tokenizer: str) -> Pieces:
        """One for all tasks of a worker."""
        if tokenizer not in cls._made:
            cls._made[tokenizer] = cls(tokenizer)
        return cls._made[tokenizer]

    def __init__(self, tokenizer: str):
        self.known = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.encoder = Encoder.get(tokenizer)
        self.size = self.encoder.tokenizer.get_vocab_size() + 1
        self.end = self.size - 1

    def begins(self) -> np.ndarray:
        """Whether an id starts a word: first ids hold the space before it, or stand alone where a space does not join."""
        vocab = self.encoder.tokenizer
        return np.array([str(vocab.id_to_token(i) or "").startswith("Ġ") for i in range(self.size - 1)] + [True])

    def of(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has. The end may be among the words once or more."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        known, ids, size = self.known
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
        ends = pc.equal(words, END).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero((at < 0) & ~ends)
        new = words.take(pa.array(fresh))
        new_ids, new_size = self.encoder.words(new)
        at[fresh] = len(size) + np.arange(len(fresh))
        at[ends] = len(size) + len(fresh)
        ids, size = np.concatenate([ids, new_ids.astype(np.int32), [np.int32(self.end)]]), np.concatenate([size, new_size, [1]])
        out = gathered(ids, size, at)[0], size[at]
        if len(known) + len(new) <= KNOWN:
            self.known = pa.concat_arrays([known, new]), ids[:-1], size[:-1]
        else:  # those of the last words
            at = at[~ends]
            self.known = words.filter(pa.array(~ends)), gathered(ids, size, at)[0], size[at]
        return out


# the attention model ------------------------------------------------------------------------------------------------


#: Rows of a product: BLAS is several times as quick on stacks of small products as on long thin ones.
ROWS = 128


def _exps(logits: Callable[[], np.ndarray], sums: Callable[[np.ndarray], np.ndarray], part: np.ndarray | None = None, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits(), 0 where part is, and their sums; where sums leave the range of floats, those of the
    differences from the greatest along the axis."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = logits()
        np.exp(z, out=z)
        if part is not None:
            z *= part
        total = sums(z)
        if total.size and not (total.min() > 1e-25 and total.max() < 1e25):
            z = logits()
            if part is not None:
                z += np.where(part > 0, np.float32(0), np.float32(-np.inf))
            z -= z.max(axis=axis, keepdims=True)
            np.exp(z, out=z)
            total = sums(z)
    return z, total


@contextmanager
def _memory_kept() -> Iterator[None]:
    """Meanwhile, freed memory stays with the process for the arrays that follow: to give back and fault in the pages of
    each is a fifth of the time. After it what is free goes back. No effect on other allocators than glibc's."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20), libc.mallopt(-1, 64 << 20)  # what is mapped apart, and what the heap's top keeps
    except (AttributeError, OSError):
        libc = None
    try:
        yield
    finally:
        if libc is not None and hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def _stacked(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of t in stacks of ROWS, and the rest."""
    k = len(t) // ROWS * ROWS
    return t[:k].reshape(-1, ROWS, t.shape[1]), t[k:]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, for a with many rows."""
    out = np.empty((len(a), b.shape[1]), np.float32)
    for x, y in zip(_stacked(a), _stacked(out), strict=True):
        np.matmul(x, b, out=y)
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, for a and b with many rows."""
    (x, x_rest), (y, y_rest) = _stacked(a), _stacked(b)
    return (x.transpose(0, 2, 1) @ y).sum(axis=0) + x_rest.T @ y_rest


@dataclass
class Attention:
    cls: np.ndarray  # class of each id; the classes of ids that start words come first
    first: np.ndarray  # whether an id starts a word
    share: np.ndarray  # natural log of each id's part of its class
    n_first: int  # classes of ids that start words
    prior: np.ndarray  # each class's part of the counts
    w: dict[str, np.ndarray]

    def factors(self, seq: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id of sequences in a row (n: their lengths): its log factor, and at ids that start a word the log
        probability that the word before has ended. An id that starts a word counts among those that do."""
        bos = len(self.cls)
        base = np.cumsum(n) - n
        m = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
        owner = np.repeat(np.arange(len(n)), m)
        start = (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)) * STRIDE
        w = self.w
        out, ended = np.zeros(len(seq), np.float32), np.zeros(len(seq), np.float32)
        inputs = w["id"] + w["class"][np.append(self.cls, len(w["class"]) - 1)]
        parts = [np.ascontiguousarray(x) for x in np.split(w["qkv"], 3, axis=1)]
        parts[0] *= DIM**-0.5
        turned = lambda t: np.ascontiguousarray(t.transpose(0, 2, 1))
        last = np.vstack([w["out"], w["bias"]])
        steps, past, in_window = np.arange(WINDOW), np.tril(np.ones((WINDOW, WINDOW), np.float32)), np.ones(WINDOW, np.float32)
        starting_classes = np.arange(len(self.prior)) < self.n_first
        whole, starting_part = np.ones((len(self.prior), 1), np.float32), starting_classes[:, None].astype(np.float32)
        prior = (PRIOR * self.prior).astype(np.float32)
        prior_starting = prior[starting_classes].sum()
        done = 0
        for i in range(0, len(owner), CHUNK):
            begin, own = start[i : i + CHUNK, None], owner[i : i + CHUNK]
            end, origin, place = n[own, None], base[own, None], begin + steps
            new = (place < end) & ((begin == 0) | (steps >= WINDOW - STRIDE))
            before = seq.take(origin + place - 1, mode="clip")
            before[begin.ravel() == 0, 0] = bos
            take = np.flatnonzero(new.ravel())
            x = inputs.take(before, axis=0)
            x += w["place"]
            flat = x.reshape(-1, DIM)
            q, k, v = (_product(flat, e).reshape(x.shape) for e in parts)
            s, total = _exps(lambda q=q, k=turned(k): q @ k, lambda s: s.reshape(-1, WINDOW) @ in_window, past)
            c = (s @ v).reshape(-1, DIM)
            c /= total[:, None]
            h = np.ones((len(take), DIM + 1), np.float32)
            np.add(flat.take(take, axis=0), _product(c.take(take, axis=0), w["mix"]), out=h[:, :DIM])
            z, total = _exps(lambda h=h: _product(h, last), lambda z: _product(z, whole)[:, 0])
            part = np.float32(1 - PRIOR) / total
            # every id is new in one window, and windows are in order
            j = slice(done, done + len(take))
            done += len(take)
            cls, starts = self.cls.take(seq[j]), self.first.take(seq[j])
            starting = np.log(_product(z, starting_part)[:, 0] * part + prior_starting)
            out[j] = np.log(z.ravel().take(np.arange(len(take)) * z.shape[1] + cls) * part + prior.take(cls)) - np.where(starts, starting, 0)
            ended[j] = np.where(starts & (place.ravel().take(take) > 0), starting, 0)
        return out + self.share[seq], ended

    def words(self, seq: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, by the windows its ids are in."""
        out, ended = self.factors(seq, n)
        start = np.flatnonzero(self.first[seq])
        word = np.add.reduceat(out.astype(float), start)
        word[:-1] += ended[start[1:]]
        return word


def _company(windows: np.ndarray, counts: np.ndarray, rows: int = 32768) -> np.ndarray:
    """Of each id and each of the most frequent ids, how often windows hold both. windows: ids, -1 after an end."""
    size = len(counts)
    common = np.argsort(-counts, kind="stable")[:COMPANY]
    n = len(common)
    # rows go by frequency, so that those in use lie together; the last is that of no id
    by = np.argsort(-counts, kind="stable")
    rank = np.full(size + 1, size)
    rank[by] = np.arange(size)
    company = np.zeros((size + 1) * n, np.uint32)
    for k in range(0, len(windows), rows):
        ids = rank.take(windows[k : k + rows], mode="wrap")
        w, place = np.nonzero(ids < n)
        held = ids[w, place]
        key = ids.take(w, axis=0)
        key *= n
        key += held[:, None]
        company += np.bincount(key.ravel(), minlength=len(company)).astype(np.uint32)
        company[np.arange(n) * (n + 1)] -= np.bincount(held, minlength=n).astype(np.uint32)  # a place is no company of its own
    return company.reshape(size + 1, n).take(rank[:size], axis=0).astype(np.float32)


def _classes(company: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and whether a class starts words: groups by company (k-means), then bins of equal mass."""
    size = len(counts)
    seen = np.flatnonzero(company.sum(axis=1) >= 5)
    group = np.zeros(size, np.int64)
    if len(seen) > GROUPS:
        v = company[seen] / company[seen].sum(axis=1, keepdims=True)
        v = np.log1p(v / np.maximum(company[seen].sum(axis=0) / company[seen].sum(), 1e-9))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        centre = [v[0]]
        for _ in range(GROUPS - 1):  # the farthest next
            centre.append(v[np.argmin(np.max(v @ np.stack(centre).T, axis=1))])
        centre = np.stack(centre)
        for _ in range(25):
            g = np.argmax(v @ centre.T, axis=1)
            centre = np.stack([v[g == k].mean(axis=0) if (g == k).any() else centre[k] for k in range(GROUPS)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        group[seen] = g
    cls, starts = np.zeros(size, np.int64), []
    for is_start, bins in ((True, START_BINS), (False, GO_BINS)):
        for k in range(GROUPS):
            m = np.flatnonzero((begins == is_start) & (group == k))
            m = m[np.argsort(-counts[m], kind="stable")]
            mass = np.cumsum(counts[m] + 0.05)
            cut = np.minimum((mass - (counts[m] + 0.05)) * bins // max(mass[-1] if len(m) else 1, 1e-9), bins - 1)
            for b in range(bins):
                x = m[cut == b]
                if len(x):
                    cls[x] = len(starts)
                    starts.append(is_start)
    return cls, np.array(starts)


def started(windows: np.ndarray, company: np.ndarray, counts: np.ndarray, begins: np.ndarray, seed: int = 1, steps: int = STEPS) -> Attention:
    """A model fitted to windows (the id before, then WINDOW ids), in steps that each draw some of them. counts: of every
    id in the training corpus."""
    rng = np.random.default_rng(seed)
    cls, starts = _classes(company, counts, begins)
    n_cls, n_first = len(starts), int(starts.sum())
    mass = np.bincount(cls, counts + 1, minlength=n_cls)
    share = np.log(counts + 1) - np.log(mass)[cls]
    f = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
    w = {"class": f(n_cls + 1, DIM), "id": np.zeros((len(cls) + 1, DIM), np.float32), "place": f(WINDOW, DIM, s=0.02), "qkv": f(DIM, 3 * DIM, s=0.25), "mix": f(DIM, DIM, s=0.25), "out": f(DIM, n_cls), "bias": np.log(mass / mass.sum()).astype(np.float32)}
    model = Attention(cls, begins, share.astype(np.float32), n_first, mass / mass.sum(), w)
    if len(windows):
        _descend(model, windows, (rng.integers(0, len(windows), BATCH) for _ in range(steps)), steps, 0.02)
    return model


def _descend(model: Attention, windows: np.ndarray, picks: Iterable[np.ndarray], steps: int, top: float) -> None:
    """Moves the model's weights by a step for each pick of windows; top: the highest rate."""
    w, cls = model.w, model.cls
    cls_in = np.append(cls, len(w["class"]) - 1)
    # all weights but those of ids are parts of one row
    dense = [k for k in w if k != "id"]
    ends = np.cumsum([w[k].size for k in dense])
    row = np.concatenate([w[k].ravel() for k in dense])
    w.update((k, x.reshape(w[k].shape)) for k, x in zip(dense, np.split(row, ends[:-1]), strict=True))
    m1, m2, m2_id = np.zeros_like(row), np.zeros_like(row), np.zeros_like(w["id"])
    flat = lambda t: t.reshape(-1, t.shape[-1])
    turned = lambda t: np.ascontiguousarray(t.transpose(0, 2, 1))
    past, scale = np.tril(np.ones((WINDOW, WINDOW), np.float32)), np.float32(DIM**-0.5)
    in_window, in_classes = np.ones(WINDOW, np.float32), np.ones(len(w["bias"]), np.float32)
    h = np.ones((0, DIM + 1), np.float32)
    for step, pick in enumerate(picks, 1):
        held = windows.take(pick, axis=0)
        i, y = np.maximum(held[:, :-1], 0), held[:, 1:].ravel()
        # each place makes something of itself and of those before it
        x = w["id"].take(i, axis=0)
        x += w["class"].take(cls_in.take(i), axis=0)
        x += w["place"]
        parts = [np.ascontiguousarray(e) for e in np.split(w["qkv"], 3, axis=1)]
        q, k, v = (_product(flat(x), e).reshape(x.shape) for e in parts)
        q *= scale
        a, total = _exps(lambda q=q, k=turned(k): q @ k, lambda a: flat(a) @ in_window, past)
        flat(a)[:] /= total[:, None]
        c = flat(a @ v)
        if len(h) != len(y):  # with a column of ones, for the bias
            h = np.ones((len(y), DIM + 1), np.float32)
        np.add(_product(c, w["mix"]), flat(x), out=h[:, :DIM])
        last, back = np.vstack([w["out"], w["bias"]]), np.ascontiguousarray(w["out"].T)
        ok = y >= 0
        part = (ok / np.float32(max(1, ok.sum()))).astype(np.float32)
        moved, dh = np.zeros_like(last), np.empty((len(y), DIM), np.float32)
        for b in range(0, len(y), PLACES):
            j = slice(b, b + PLACES)
            p, total = _exps(lambda h=h[j], last=last: _product(h, last), lambda p: p @ in_classes)
            p.ravel()[np.arange(0, p.size, p.shape[1]) + cls.take(y[j], mode="wrap")] -= total
            share = (part[j] / total)[:, None]
            np.multiply(_product(p, back), share, out=dh[j])
            moved += _inner(h[j] * share, p)
        g = {"out": moved[:DIM], "bias": moved[DIM], "mix": _inner(c, dh)}
        dc = _product(dh, np.ascontiguousarray(w["mix"].T)).reshape(x.shape)
        da = dc @ turned(v)
        da -= (flat(da * a) @ in_window).reshape(*i.shape, 1)
        da *= a
        grads = [flat(e) for e in (da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dc)]
        grads[0] *= scale
        g["qkv"] = np.concatenate([_inner(flat(x), e) for e in grads], axis=1)
        dx = dh
        for e, weight in zip(grads, parts, strict=True):
            dx += _product(e, np.ascontiguousarray(weight.T))
        g["place"] = dx.reshape(len(i), -1).sum(axis=0).reshape(WINDOW, DIM)
        # only the ids of this batch move
        order = np.argsort(i.ravel().astype(np.uint16 if len(cls) < 2**16 else i.dtype), kind="stable")
        run = i.ravel().take(order)
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        u, d = run[at], np.add.reduceat(np.ascontiguousarray(dx.take(order, axis=0).T), at, axis=1)
        of = cls_in.take(u)
        order = np.argsort(of.astype(np.uint16), kind="stable")
        run = of.take(order)
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        g["class"] = np.zeros_like(w["class"])
        g["class"][run[at]] = np.add.reduceat(d.take(order, axis=1), at, axis=1).T
        rate = top * min(1.0, step / 50) * (1 - step / (steps + 1))
        e = np.concatenate([g[k].ravel() for k in dense])
        m1 += 0.1 * (e - m1)
        m2 += 0.01 * (e * e - m2)
        row -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        d = np.ascontiguousarray(d.T)
        square = m2_id.take(u, axis=0) + d * d
        m2_id[u] = square
        w["id"][u] -= rate * d / (np.sqrt(square) + 1e-6)


# batches of documents -----------------------------------------------------------------------------------------------


@dataclass
class Coded:
    """The documents of a batch: their words, each with its end, as numbers of the batch's different words, whose ids lie
    in a row."""

    at: np.ndarray
    n: np.ndarray  # words of each document
    held: np.ndarray
    ids: np.ndarray
    size: np.ndarray  # ids of each different word

    SCHEMA = "batch long, n_train long, n_words long, n_different long, n_windows long, doc_id array<long>, held array<boolean>, n array<long>, at binary, ids binary, size binary"

    @classmethod
    def of(cls, texts: pa.Array, held: np.ndarray, pieces: Pieces) -> Coded:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        some = pc.greater(pc.binary_length(words), 0)
        words, owner = words.filter(some), owner[some.to_numpy(zero_copy_only=False)]
        n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        numbered = words.dictionary_encode()
        different = pa.concat_arrays([numbered.dictionary, pa.array([END], numbered.dictionary.type)])
        at = np.insert(numbered.indices.to_numpy().astype(np.int64), np.cumsum(n), len(different) - 1)
        # frequent words have small numbers, which take less room
        order = np.argsort(-np.bincount(at, minlength=len(different)), kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        ids, size = pieces.of(different.take(pa.array(order)))
        return cls(number[at], n + 1, held, ids, size)

    def record(self, batch: int, doc_ids: pa.Array) -> pa.RecordBatch:
        n_ids = self.sums(self.size[self.at])
        windows = int((-(-n_ids // SPAN))[~self.held].sum())
        row = [batch, int(self.n[~self.held].sum()), len(self.at), len(self.size), windows, doc_ids.to_pylist(), self.held.tolist(), self.n.tolist()]
        planes = np.ascontiguousarray(self.at.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        row += [zstandard.compress(planes.tobytes(), 1), _small(self.ids), _small(self.size)]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in self.SCHEMA.split(", ")])

    @classmethod
    def read(cls, b: pa.RecordBatch, k: int) -> Coded:
        planes = np.frombuffer(zstandard.decompress(b.column("at")[k].as_buffer()), np.uint8).reshape(4, -1)
        at = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        n, held = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("n", "held"))
        ids, size = (_large(b.column(c)[k].as_py(), 1)[0] for c in ("ids", "size"))
        return cls(at, n, held.astype(bool), ids.astype(np.int32), size)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over documents of a value for each word."""
        return np.add.reduceat(x, np.cumsum(self.n) - self.n)

    def learned(self) -> np.ndarray:
        """Whether each word is of a training document."""
        return np.repeat(~self.held, self.n)

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' ids in a row, and how many each document has."""
        seq, _ = gathered(self.ids, self.size, self.at)
        return seq, self.sums(self.size[self.at])

    def windows(self, _batch: int = 0) -> np.ndarray:
        """The windows (the id before, then WINDOW ids) of all training documents, one after the other; -1 after a
        document's end, -2 before its start."""
        seq, n = self.sequence()
        base = np.cumsum(n) - n
        doc = np.flatnonzero(~self.held)
        k = -(-n[doc] // SPAN)
        owner = np.repeat(doc, k)
        span = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        first = np.cumsum(k) - k
        out = seq.take((base[owner] + span * SPAN)[:, None] + np.arange(-1, WINDOW), mode="clip").astype(np.int32, copy=False)
        tail = first + k - 1
        out[tail] = np.where((k[:, None] - 1) * SPAN + np.arange(-1, WINDOW) < n[doc, None], out[tail], -1)
        out[first, 0] = -2
        return out

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each different word, from its ids."""
        start = np.cumsum(self.size) - self.size
        place = (np.arange(len(self.ids)) - np.repeat(start, self.size)).astype(_U)
        ids = self.ids.astype(_U)
        return tuple(_mix(np.add.reduceat(_mix(ids * _U(a) + (place + _U(1)) * _U(b)), start)) for a, b in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))

    def pairs(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of a context (the two words before) and a word, by bucket: the bucket, 40 bits of the context
        and 24 of the word, how many training words have it; and for each word of the batch, which pair it has."""
        h = self.hashes()[0][self.at]
        first = np.zeros(len(h), bool)
        first[np.cumsum(self.n) - self.n] = True
        one = np.concatenate([h[:1], h[:-1]])
        one[first] = _U(1)
        two = np.concatenate([one[:1], one[:-1]])
        two[first] = _U(2)
        context = _mix(one * _U(0x9E3779B97F4A7C15) + _mix(two))
        key = (context << _U(24)) | (h >> _U(40))
        # sorted by bucket, then by key; equal keys of other buckets meet once in 2**40
        bucket = (((context >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.uint32)
        key, which, first = _numbered(key)
        bucket = bucket[first]
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 2**16 else bucket, kind="stable")  # by digits, if few
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        times = np.bincount(which[self.learned()], minlength=len(key))
        return bucket[order].astype(np.int64), key[order], times[order], place[which]

    def different(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different words by bucket: the bucket, two hashes, how many training words are it; and each word's place here."""
        a, b = self.hashes()
        order = np.argsort(a, kind="stable")
        times = np.bincount(self.at[self.learned()], minlength=len(a))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        bucket = (((a[order] >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)
        # 96 bits of each word
        return bucket, np.stack([a, b >> _U(32)], axis=1)[order], times[order], place


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, sorted; the number of each key among them; and where one of each is."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(key) else np.zeros(0, bool)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], which, order[new]


def _planes(key: np.ndarray, width: int) -> bytes:
    """Sorted numbers, by bytes from the highest of `width`, compressed: the higher bytes change slowly."""
    rows = np.ascontiguousarray(key, ">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return zstandard.compress(np.ascontiguousarray(rows.T).tobytes(), 1)


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, 8 - width :] = rows.T
    return out.view(">u8").ravel().astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def code(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the documents as batches of Coded, and returns the table."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")).cast("binary")) % FOLDS == HELD_OUT).alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, k = Pieces.get(tokenizer), TaskContext.get().partitionId() << 32
        for big in it:
            for b in batches(big, 1 << 16, BATCH_BYTES):
                coded = Coded.of(b.column("text"), b.column("held").to_numpy(zero_copy_only=False).astype(bool), pieces)
                yield coded.record(k, b.column("doc_id"))
                k += 1

    return materialise(rows.mapInArrow(run, Coded.SCHEMA), "coded", compression="none")


# the fit ------------------------------------------------------------------------------------------------------------


def _id_counts(coded: DataFrame, size: int) -> np.ndarray:
    """Of every id, its count in the training documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            for k in range(b.num_rows):
                c = Coded.read(b, k)
                times = np.bincount(c.at[c.learned()], minlength=len(c.size))
                total += np.bincount(c.ids, np.repeat(times, c.size), minlength=size)
        u = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(total[u].astype(np.int64))], ["id", "n"])

    out = np.zeros(size)
    for r in coded.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary's size
        out[r["id"]] = r["n"]
    return out


SUMS = "key int, src long, n double, v binary"


def _sums(key: Iterable[int], src: int, n: Iterable[float], v: Iterable[np.ndarray]) -> pa.RecordBatch:
    key = list(key)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([src] * len(key), pa.int64()), pa.array(n, pa.float64()), pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())], ["key", "src", "n", "v"])


def _summed(parts: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """Of each key, the sums of n and of the vectors v, added in the order of src. Keys are ids and a few more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, v = None, 0.0, np.zeros(0)
        for b in it:
            for k, m, raw in zip(*(b.column(c).to_pylist() for c in ("key", "n", "v")), strict=True):
                x = np.frombuffer(raw, "<f4")
                if k == key:
                    n, v = n + m, v + x
                    continue
                if key is not None:
                    yield _sums([key], 0, [n], [v])
                key, n, v = k, m, x.astype(float)
        if key is not None:
            yield _sums([key], 0, [n], [v])

    rows = parts.repartition("key").sortWithinPartitions("key", "src").mapInArrow(run, SUMS).collect()  # the vocabulary's size
    return {r["key"]: (r["n"], np.frombuffer(r["v"], "<f4")) for r in rows}


def _few(coded: DataFrame, n: int) -> DataFrame:
    """The batches in few enough partitions that each has about SHARD_WINDOWS of all n windows."""
    return coded.select("batch", "held", "n", "at", "ids", "size").coalesce(max(1, round(n / SHARD_WINDOWS)))


def _shards(coded: DataFrame, size: int, n: int, f, schema: str) -> DataFrame:
    """What f makes of each shard: windows in the order of the table, of a partition or SHARD_WINDOWS and the rest of a
    batch, whichever is less; and the number of its first batch. size stands for the id before a document's start."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, []
        for b in it:
            for k, batch in enumerate(b.column("batch").to_pylist()):
                windows = Coded.read(b, k).windows()
                windows[windows == -2] = size
                if not len(windows):
                    continue
                first = batch if first is None else first
                held.append(windows)
                if sum(map(len, held)) >= SHARD_WINDOWS:
                    yield from f(np.concatenate(held), first)
                    first, held = None, []
        if held:
            yield from f(np.concatenate(held), first)

    return _few(coded, n).mapInArrow(run, schema)


def _passed(model: Attention, windows: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
    """How a pass over a shard's windows moves the model: each weight's move times its windows or occurrences."""
    w = {k: v.copy() for k, v in model.w.items()}
    n = len(windows)
    order = np.random.default_rng(shard).permutation(n)
    moved = replace(model, w=w)
    with _memory_kept():
        _descend(moved, windows, (order[k : k + PASS_BATCH] for k in range(0, n, PASS_BATCH)), -(-n // PASS_BATCH), PASS_RATE)
    # what follows an end is padding, and no occurrence
    times = np.bincount(windows[:, :-1][windows[:, 1:] >= 0], minlength=len(w["id"]))
    u = np.flatnonzero(times)
    dense = [k for k in w if k != "id"]
    yield _sums([-1 - k for k in range(len(dense))], shard, [float(n)] * len(dense), [(w[k] - model.w[k]).ravel() * n for k in dense])
    for k in range(0, len(u), 4096):
        j = u[k : k + 4096]
        yield _sums(j.tolist(), shard, times[j].astype(float), (w["id"][j] - model.w["id"][j]) * times[j, None])


def _windows_of(coded: DataFrame, some: list[int], size: int) -> np.ndarray:
    """The windows of a few batches, in their order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k, batch in enumerate(b.column("batch").to_pylist()):
                windows = Coded.read(b, k).windows()
                windows[windows == -2] = size
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([zstandard.compress(windows.astype("<i4").tobytes(), 1)], pa.binary())], ["batch", "windows"])

    found = coded.where(F.col("batch").isin(some)).mapInArrow(run, "batch long, windows binary").collect() if some else []
    raw = [zstandard.decompress(bytes(r["windows"])) for r in sorted(found, key=lambda r: r["batch"])]
    return np.concatenate([np.zeros((0, WINDOW + 1), np.int32), *(np.frombuffer(x, "<i4").reshape(-1, WINDOW + 1) for x in raw)])


def fit(coded: DataFrame, tokenizer: str = TOKENIZER) -> Attention:
    """The model, from all training documents of a table of batches. Reruns agree to rounding."""
    context = coded.sparkSession.sparkContext
    pieces = Pieces(tokenizer)
    begins, counts = pieces.begins(), _id_counts(coded, pieces.size)
    n = coded.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    shared = context.broadcast(counts)
    common = min(COMPANY, pieces.size)
    rows = -(-pieces.size // COMPANY_BLOCKS)

    def company_of(windows: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
        company = _company(windows[:, 1:], shared.value).astype("<u4")
        raw = [zstandard.compress(company[k * rows : (k + 1) * rows].tobytes(), 1) for k in range(COMPANY_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COMPANY_BLOCKS), pa.int32()), pa.array(raw, pa.binary())], ["block", "v"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for k, raw in zip(b.column("block").to_pylist(), b.column("v").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(raw), "<u4").astype(np.int64)
        raw = [zstandard.compress(x.astype("<f4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(raw, pa.binary())], ["block", "v"])

    company = np.zeros((pieces.size, common), np.float32)
    blocks = _shards(coded, pieces.size, n, company_of, "block int, v binary").repartition(COMPANY_BLOCKS, "block").mapInArrow(add, "block int, v binary")
    for r in blocks.collect():  # the vocabulary's size
        company[r["block"] * rows : (r["block"] + 1) * rows] = np.frombuffer(zstandard.decompress(bytes(r["v"])), "<f4").reshape(-1, common)
    # the start is fitted to the windows of enough batches for its steps, chosen by a hash; what follows goes over all
    enough, some = 0, []
    for r in coded.select("batch", "n_windows", F.xxhash64("batch").alias("h")).orderBy("h").limit(max(1, STEPS * BATCH // 1000)).collect():
        if enough < STEPS * BATCH // 2:
            some.append(r["batch"])
            enough += r["n_windows"]
    start = started(_windows_of(coded, some, pieces.size), company, counts, begins, steps=STEPS)
    model = context.broadcast(start)
    w = {k: v.copy() for k, v in start.w.items()}
    dense = [k for k in w if k != "id"]
    for k, (m, v) in _summed(_shards(coded, pieces.size, n, lambda windows, shard: _passed(model.value, windows, shard), SUMS)).items():
        if k < 0:
            w[dense[-1 - k]] += (v / m).reshape(w[dense[-1 - k]].shape)
        else:
            w["id"][k] += v / m
    return replace(start, w=w)


# counts of the corpus -----------------------------------------------------------------------------------------------


def _small(*arrays: np.ndarray) -> bytes:
    """Arrays of counts of one length, each in as few bytes as its largest needs."""
    kinds = [np.min_scalar_type(int(x.max()) if len(x) else 0) for x in arrays]
    return b"".join([bytes(k.itemsize for k in kinds), *(x.astype(k.newbyteorder("<")).tobytes() for x, k in zip(arrays, kinds, strict=True))])


def _large(raw: bytes, arrays: int) -> list[np.ndarray]:
    n, at, out = (len(raw) - arrays) // sum(raw[:arrays]), arrays, []
    for width in raw[:arrays]:
        out.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    return out


def _asked(coded: DataFrame, word_buckets: int, pair_buckets: int) -> DataFrame:
    """bucket, batch, keys, more, n: different words (buckets below 0, with 32 more bits) and pairs of a batch with their
    training counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, batch in enumerate(b.column("batch").to_pylist()):
                c = Coded.read(b, i)
                for sign, (bucket, key, times, _) in ((-1, c.different(word_buckets)), (1, c.pairs(pair_buckets))):
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                    number = bucket[cut[:-1]] if sign > 0 else -1 - bucket[cut[:-1]]
                    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    keys = pa.array([_planes(key[x:y], 8) if sign > 0 else _planes(key[x:y, 0], 8) for x, y in spans], pa.binary())
                    more = pa.array([None if sign > 0 else key[x:y, 1].astype("<u4").tobytes() for x, y in spans], pa.binary())
                    n = pa.array([zstandard.compress(_small(times[x:y]), 1) for x, y in spans], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array([batch] * len(spans), pa.int64()), keys, more, n], ["bucket", "batch", "keys", "more", "n"])

    return coded.mapInArrow(run, "bucket int, batch long, keys binary, more binary, n binary")


def _answers(bucket: int, held: list[tuple[int, bytes, bytes | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's keys, as each batch asked for them, the counts over all batches: of a word; or of a pair, of its
    context, and of the different words after it. The first row holds the bucket's words, or pairs of count 1 and 2."""
    each = [_large(zstandard.decompress(n), 1)[0] for *_, n in held]
    times = np.concatenate(each)
    key = np.concatenate([_from_planes(k, 8) for _, k, *_ in held])
    one = two = 0
    if bucket < 0:
        other = np.concatenate([np.frombuffer(m, "<u4") for *_, m, _ in held])
        order = np.lexsort((other, key))
        a, b = key[order], other[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        count = np.bincount(which, times).astype(np.int64)
        one = int((count > 0).sum())
        out = [count[which]]
    else:
        key, which, _ = _numbered(key)
        count = np.bincount(which, times).astype(np.int64)
        one, two = int((count == 1).sum()), int((count == 2).sum())
        context = key >> _U(24)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        back = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        of = [np.add.reduceat(x, start)[back] for x in (count, (count > 0).astype(np.int64))]
        out = [x[which] for x in (count, *of)]
    cut = np.cumsum([0, *map(len, each)]).tolist()
    raw = pa.array([zstandard.compress(_small(*(x[a:b] for x in out)), 1) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    first = [1] + [0] * (len(held) - 1)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), raw, pa.array([one * x for x in first], pa.int64()), pa.array([two * x for x in first], pa.int64())], ["batch", "bucket", "counts", "one", "two"])


def counted(coded: DataFrame, keys: int = KEYS) -> tuple[DataFrame, int, float]:
    """batch, bucket, counts: the corpus's counts of each batch's words and pairs, written; the number of different
    training words; and the discount."""
    n = coded.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_different"), F.lit(0))).first()
    asked = _asked(coded, max(1, -(-n[1] // keys)), max(1, -(-n[0] // keys)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in it:
            for bucket, *rest in zip(*(b.column(c).to_pylist() for c in ("bucket", "batch", "keys", "more", "n")), strict=True):
                if bucket != now and held:
                    yield from _answers(now, held)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield from _answers(now, held)

    out = asked.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, "batch long, bucket int, counts binary, one long, two long")
    out = materialise(out, "counts", compression="none")
    sums = lambda c, which: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))
    words, one, two = out.agg(sums("one", F.col("bucket") < 0), sums("one", F.col("bucket") >= 0), sums("two", F.col("bucket") >= 0)).first()
    return out.select("batch", "bucket", "counts"), int(words), one / (one + 2 * two) if one and two else 0.5


def mixed(word: np.ndarray, count: np.ndarray, context: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """log P(w | u v): word is log P(w | window); counts of u v w, of u v, and of different words after u v."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log(np.maximum(count - discount, 0) / context)
        rest = np.log(discount * kinds / context) + word
        return np.where(context > 0, np.logaddexp(own, rest), word)


def scored(coded: DataFrame, model: Attention, keys: int = KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the documents in a table of batches.

    keys: different keys of a bucket, about."""
    counts, v_all, discount = counted(coded, keys)
    n_all, n_words, n_different = (int(x) for x in coded.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_words", "n_different"))).first())
    buckets = max(1, -(-n_different // keys)), max(1, -(-n_words // keys))
    shared = coded.sparkSession.sparkContext.broadcast(model)
    log_all = np.log10(n_all + v_all + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = shared.value, []
        for b in it:
            for k, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket is not None:  # counts come first, by bucket: words from the last to the first, then pairs
                    held.append((bucket, zstandard.decompress(b.column("counts")[k].as_py())))
                    continue
                c = Coded.read(b, k)
                *_, place = c.different(buckets[0])
                of_word = np.concatenate([_large(raw, 1)[0] for i, raw in sorted((x for x in held if x[0] < 0), reverse=True)])[place][c.at]
                *_, place = c.pairs(buckets[1])
                of_pair = [np.concatenate(x)[place] for x in zip(*(_large(raw, 3) for i, raw in sorted(x for x in held if x[0] >= 0)), strict=True)]
                held = []
                seq, n = c.sequence()
                score = c.sums(mixed(model.words(seq, n), *of_pair, discount)) / np.log(10)
                base = c.sums(np.log10(of_word + 1.0)) - c.n * log_all
                doc_ids = b.column("doc_id")[k].values
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(c.held), pa.array(c.n), pa.array(c.sums((of_word > 0).astype(np.int64))), pa.array(np.full(len(c.n), n_all)), pa.array(base), pa.array(score)], names)

    columns = ["batch", "bucket", "counts", "doc_id", "held", "n", "at", "ids", "size"]
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    asked = counts.select(*(c if c in counts.columns else nothing(coded, c) for c in columns))
    both = asked.unionByName(coded.select(*(c if c in coded.columns else nothing(counts, c) for c in columns)))
    both = both.repartition("batch").sortWithinPartitions("batch", F.col("bucket").asc_nulls_last())
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs.

    A null or blank text is the end alone. Very long texts are scored whole, one at a time. Repeated rows stay and count
    each. Without training documents every word is unknown. An empty table gives no rows. Other columns, of whatever
    name, are ignored.
    """
    coded = code(docs, tokenizer)
    return scored(coded, fit(coded, tokenizer))
