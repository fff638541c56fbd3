"""Helpers shared by the training-data operators: tables, shared scratch space, words and subword ids."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a local session (tests) gets a temporary folder; on a cluster, where such a folder would be
    another one on each machine, this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a copy in the shared folder, which survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: bytes.lower() and bytes.split() do exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Encoder:
    """Subword ids of whole texts, as unsigned 32-bit integers, by a byte-level BPE of the tokenizers library.

    Texts are cut before each space. The pre-tokenizer starts a piece there, too, unless the space stands inside a run of
    white space; texts with such a run, or with two spaces in a row, are encoded whole. Arrow cuts the texts and numbers
    the different cuts of a batch, which are looked up in a bounded cache; only unseen ones reach the tokenizer, many at a
    time. The result equals encoding each whole text.
    """

    LIMIT = 400_000
    JOIN = 4000
    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it would be asked for unseen words only
        self.cache: dict[str, bytes] = {}
        lf = self._ids(["\n"])[0]
        self.lf = int(np.frombuffer(lf, "<u4")[0]) if len(lf) == 4 else None
        self.cache["\n"] = lf
        self.spaced = np.array([str(self.tokenizer.id_to_token(i) or "").startswith(_BYTES[32]) for i in range(self.tokenizer.get_vocab_size())])
        self.pieces = self._bare()

    def _bare(self):
        """The byte-pair model alone, for pieces whose bytes are written as letters already; None if it isn't that kind."""
        from tokenizers import Tokenizer

        plain = self.tokenizer.pre_tokenizer.__class__.__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        if not plain or self.lf is None:
            return None
        bare = Tokenizer(self.tokenizer.model)
        probe = " A\u00e9"
        ids = bare.encode([probe.encode().decode("latin-1").translate(_BYTES)], is_pretokenized=True).ids
        return bare if np.array(ids, "<u4").tobytes() == self._ids([probe])[0] else None

    @classmethod
    def get(cls, name: str = TOKENIZER) -> Encoder:
        """name: a byte-level BPE file of the public_tokenizers package, or a path."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if name not in cls._made:
            import public_tokenizers

            cls._made[name] = cls(name if os.path.sep in name else public_tokenizers.path(name))
        return cls._made[name]

    @classmethod
    def drop(cls, name: str = TOKENIZER) -> None:
        """Gives the encoder's memory back: other stages follow in the same worker."""
        cls._made.pop(name, None)
        pa.default_memory_pool().release_unused()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, each encoded by itself with a space before it, and how many each has. Nothing is kept.

        A word of Latin letters is one piece, and so are the marks after it; pieces go to the byte-pair model as they are.
        The first id of a word, and no other, holds its space.
        """
        if not isinstance(words, pa.Array):
            words = pa.array(words, pa.string())
        parted = pc.replace_substring_regex(words, f"([{_MARK_CLASS}]+)$", "\n\\1")
        plain = pc.match_substring_regex(parted, f"^[{_LETTER_CLASS}]+(\n[{_MARK_CLASS}]+)?$").to_numpy(zero_copy_only=False) & (self.pieces is not None)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, size = [np.zeros(0, "<u4")], np.zeros(len(words), np.int64)
        if len(at):
            text = " " + "\n ".join(strings(parted.take(pa.array(at))))
            pieces = text.encode().decode("latin-1").translate(_BYTES).split(_BYTES[10])
            parts = [pieces[i : i + self.JOIN] for i in range(0, len(pieces), self.JOIN)]
            got = self.pieces.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.concatenate([np.array(x.ids, "<u4") for x in got]))
            size[at] = np.diff(np.append(np.flatnonzero(self.spaced[ids[-1]]), len(ids[-1])))
        if len(rest):
            raw = self._ids([" " + w for w in strings(words.take(pa.array(rest)))])
            size[rest] = [len(x) // 4 for x in raw]
            ids.append(np.frombuffer(b"".join(raw), "<u4"))
        order = np.concatenate([at, rest])
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return gathered(np.concatenate(ids), size[order], place)[0], size

    def _several(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of cuts without line feeds and white space at their ends: joined by line feeds, each a piece of its own."""
        out: dict[str, bytes] = {}
        for i in range(0, len(cuts), self.JOIN):
            part = cuts[i : i + self.JOIN]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.lf)
            if len(at) != len(part) - 1:
                out.update(zip(part, self._ids(part), strict=True))
                continue
            raw, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out.update(zip(part, [raw[x:y] for x, y in zip([0, *(4 * at + 4).tolist()], ends, strict=True)], strict=True))
        return out

    def cuts(self, new: list[str]) -> dict[str, bytes]:
        """Ids of single cuts."""
        lines: list[tuple[str, str, str]] = []
        spaced, plain, alone = [], [], []
        for c in new:
            a, feed, b = c.partition("\n")
            if feed:  # one line feed between two words parts them
                if self.lf is not None and a and b and "\n" not in b and not (a[-1].isspace() or b[0].isspace() or b[-1].isspace() or a[a[0] == " " :][:1].isspace()):
                    lines.append((c, a, b))
                else:
                    alone.append(c)
            elif self.lf is None or not c or c[-1].isspace() or c[c[0] == " "].isspace():
                alone.append(c)
            else:
                (spaced if c[0] == " " else plain).append(c)
        known = self.cache
        for c in dict.fromkeys(x for _, a, b in lines for x in (a, b)):
            if c not in known:
                (spaced if c[0] == " " else plain).append(c)
        out = self._several(plain)
        if spaced:
            out.update(zip(spaced, self._raw(pa.array([c[1:] for c in spaced], pa.string())), strict=True))
        if alone:
            out.update(zip(alone, self._ids(alone), strict=True))
        if lines:
            lf, find = known["\n"], lambda c: out[c] if c in out else known[c]
            out.update([(c, find(a) + lf + find(b)) for c, a, b in lines])
        return out

    def _raw(self, words: pa.Array) -> list[bytes]:
        ids, size = self.words(words)
        raw, ends = ids.tobytes(), np.cumsum(4 * size).tolist()
        return [raw[x:y] for x, y in zip([0, *ends][: len(ends)], ends, strict=True)]

    def flat(self, texts: pa.Array | Iterable[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the id `end` after it if there is one, and where each text begins
        in it (one more entry, for the last one's end)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(texts), pa.string())
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        n = pc.list_value_length(split).to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        different, code = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        k, first = len(different), np.cumsum(n) - n
        starting = np.zeros(len(code), bool)
        starting[first] = True
        # a space inside a run of white space, or at a text's end, begins no piece
        edge = lambda x: pc.utf8_is_space(x).to_numpy(zero_copy_only=False)
        lead, trail = edge(pc.utf8_slice_codeunits(different, 0, 1)), edge(pc.utf8_slice_codeunits(different, -1))
        none = pc.equal(pc.binary_length(different), 0).to_numpy(zero_copy_only=False)
        odd = none[code] & ~starting
        odd[1:] |= trail[code[:-1]] & lead[code[1:]] & ~starting[1:]
        whole = np.flatnonzero(np.logical_or.reduceat(odd, first)) if len(n) else first
        code[starting] += k  # the first cut of a text has no space before it
        used = np.flatnonzero(np.bincount(code, minlength=2 * k))
        names = strings(different)
        cuts = [" " + names[c] if c < k else names[c - k] for c in used.tolist()]
        raw = list(map(self.cache.get, cuts))
        new = np.flatnonzero(np.fromiter((x is None for x in raw), bool, len(raw)))
        if len(new):
            # words with a space before them go to the model together
            of = used[new] % max(k, 1)
            word = (used[new] < k) & ~lead[of] & ~trail[of] & ~none[of] & ~pc.match_substring(different, "\n").to_numpy(zero_copy_only=False)[of]
            some, other = new[word].tolist(), new[~word].tolist()
            for i, x in zip(some, self._raw(different.take(pa.array(of[word]))), strict=True):
                raw[i] = x
            made = self.cuts([cuts[i] for i in other])
            for i in other:
                raw[i] = made[cuts[i]]
            if len(self.cache) < self.LIMIT:
                self.cache.update((c, x) for c, x in made.items() if len(c) <= 32)
                self.cache.update([(cuts[i], raw[i]) for i in some if len(cuts[i]) <= 32])
        number = np.zeros(2 * k + 1 + len(whole), np.int64)
        number[used] = np.arange(len(used))
        if end is not None:
            number[2 * k] = len(raw)
            raw.append(np.array([end], "<u4").tobytes())
        number[2 * k + 1 :] = len(raw) + np.arange(len(whole))
        raw += self._ids([texts[i].as_py() for i in whole.tolist()]) if len(whole) else []
        if len(whole):  # such a text is one cut
            keep = np.repeat(~np.isin(np.arange(len(n)), whole), n)
            keep[first[whole]] = True
            code[first[whole]] = 2 * k + 1 + np.arange(len(whole))
            code, n = code[keep], n.copy()
            n[whole] = 1
        if end is not None:
            code = np.insert(code, np.cumsum(n), 2 * k)
            n = n + 1
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        out, sums = gathered(np.frombuffer(b"".join(raw), "<u4"), size, number[code])
        return out, sums[np.concatenate([[0], np.cumsum(n)])]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        ids, at = self.flat(texts)
        return [ids[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def strings(array: pa.Array) -> list[str]:
    """An Arrow array of texts as a list, in one step."""
    return array.to_numpy(zero_copy_only=False).tolist()


def gathered(values: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values lie in runs of these sizes: the runs number `at`, one after the other, and where each of them begins."""
    first = np.cumsum(size) - size
    each = size[at]
    sums = np.concatenate([[0], np.cumsum(each)])
    return values[np.repeat(first[at] - sums[:-1], each) + np.arange(sums[-1])], sums


#: ASCII punctuation, which the pre-tokenizer keeps apart from letters and digits, and Latin letters, as classes of patterns.
_MARK_CLASS = r"!-/:-@\[-`{-~"
_LETTER_CLASS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 0x100 + others.index(b)) for b in range(256)}


_BYTES = _byte_letters()


def fewest(df: DataFrame, name: str, most: int) -> DataFrame:
    """At most `most` rows of df, those with the least hash of doc_id (ties in any order).

    Rows far above the cut are dropped where they are read, so that no partition sends its own `most` rows.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(name), F.col("doc_id").cast("long")), 1)
    n = df.count()
    if n > 2 * most:
        df = df.where(h < int(2**63 * min(1.0, (1.2 * most + 50) / n)))
    return df.orderBy(h).limit(most)


def batches(batch: pa.RecordBatch, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of at most so many rows and bytes of text, to bound what Python holds at once. A longer
    text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    total = np.zeros(n, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(total)
    at = 0
    while at < n:
        most = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
        end = max(at + 1, min(at + rows, most, n))
        yield batch.slice(at, end - at)
        at = end


#: Keys that are split are the most frequent ones: no more than this, whatever the size of the table.
MOST_HOT = 65_536


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", least: int = 4096) -> DataFrame | None:
    """keys and salts int: the keys with more than `least` rows, and more than a MOST_HOT-th of all, and in how many parts
    to deal them; None if there are none. counts: keys, n. At most MOST_HOT rows, so that the result may be broadcast."""
    total, top = counts.agg(F.sum(n), F.max(n)).first()
    most = max(least, -(-int(total or 0) // MOST_HOT))
    if (top or 0) <= most:
        return None
    return counts.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("salts"))


def salted(rows: DataFrame, hot: DataFrame | None, keys: list[str], by: Column) -> DataFrame:
    """rows with salt int: the part that a row of a hot key goes to, by a hash of `by`; 0 for the others."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def spread(rows: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """rows (few for a key) with salt int: one copy for each part of a hot key."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
