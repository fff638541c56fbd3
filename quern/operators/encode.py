"""Encoding of token sequences as ids: special tokens, truncation, padding, masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of the special tokens.
PAD, UNKNOWN, END, START, MASK = 0, 1, 2, 3, 4
SPECIALS = (PAD, UNKNOWN, END, START, MASK)
PADDINGS = ("longest", "max_length", "do_not_pad")
TRUNCATIONS = ("longest_first", "only_first", "only_second", "do_not_truncate")


def _ids(*values: int) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values)) if values else F.array().cast("array<long>")


def repeated(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("long"), F.greatest(n, F.lit(0)).cast("int"))


@dataclass(frozen=True)
class Strategy:
    padding: str
    truncation: str
    max_length: int | None


def strategy(padding: bool | str = False, truncation: bool | str | None = None, max_length: int | None = None, multiple: int | None = None, longest: int | None = None) -> Strategy:
    """What the arguments of an encoding call come to.

    True stands for padding to the longest and for cutting the longer of a pair; False and None for neither. Without a
    max_length `longest`, a model's limit, stands in; without that, nothing is cut, and nothing padded to a maximum.
    Raises ValueError for unknown names, and for a maximum that is cut and padded to but no multiple of `multiple`.
    """
    pad = "longest" if padding is True else padding or "do_not_pad"
    cut = "longest_first" if truncation is True else truncation or "do_not_truncate"
    if pad not in PADDINGS:
        raise ValueError(f"{pad!r} is no padding; there are {', '.join(PADDINGS)}")
    if cut not in TRUNCATIONS:
        raise ValueError(f"{cut!r} is no truncation; there are {', '.join(TRUNCATIONS)}")
    if max_length is None:
        if longest is None:
            pad, cut = "do_not_pad" if pad == "max_length" else pad, "do_not_truncate"
        elif pad == "max_length" or cut != "do_not_truncate":
            max_length = longest
    if multiple and max_length and pad != "do_not_pad" and cut != "do_not_truncate" and max_length % multiple:
        raise ValueError(f"the length {max_length} is no multiple of {multiple}")
    return Strategy(pad, cut, max_length)


def truncated(a: Column, b: Column, most: Column) -> tuple[Column, Column]:
    """Lengths of a pair cut to `most`: from the longer first, then in turn, the second first."""
    r = F.greatest(a + b - most, F.lit(0))
    m = F.least(r, F.abs(a - b))
    rest = r - m
    return a - F.when(a > b, m).otherwise(0) - F.floor(rest / 2), b - F.when(b > a, m).otherwise(0) - F.ceil(rest / 2)


def kept(ids: Column, n: Column, side: str = "right") -> Column:
    """n of the ids; side: where they are cut off."""
    n = n.cast("int")
    return F.slice(ids, 1, n) if side == "right" else F.slice(ids, F.size(ids) - n + 1, n)


def cut_pair(a: Column, b: Column, remove: Column, how: str = "longest_first", side: str = "right", stride: int = 0) -> tuple[Column, Column, Column]:
    """Both sequences without `remove` ids in all, and the ids cut off with `stride` more; those only where one sequence is
    cut. A sequence that is too short to lose so many stays whole. b: null literal for a single sequence."""
    remove = F.greatest(remove, F.lit(0)).cast("int")
    none = _ids()
    if how == "do_not_truncate":
        return a, b, none
    if how == "longest_first" and b is not None:
        x, y = truncated(F.size(a), F.size(b), F.size(a) + F.size(b) - remove)
        return kept(a, x, side), kept(b, y, side), none
    if how == "only_second" and b is None:
        return a, b, none
    own = b if how == "only_second" else a
    fits = F.size(own) > remove
    over = F.least(F.size(own), F.lit(stride) + remove)
    lost = F.when(fits & (remove > 0), F.slice(own, F.size(own) - over + 1, over) if side == "right" else F.slice(own, F.lit(1), over)).otherwise(none)
    short = F.when(fits, kept(own, F.size(own) - remove, side)).otherwise(own)
    return (a, short, lost) if how == "only_second" else (short, b, lost)


def special(a: Column, b: Column | None = None) -> Column:
    """start a end, or start a end b end."""
    first = F.concat(_ids(START), a, _ids(END))
    return first if b is None else F.concat(first, b, _ids(END))


def type_ids(a: Column, b: Column | None = None) -> Column:
    """0 for the first sequence with its special tokens, 1 for the second with its end."""
    first = repeated(0, F.size(a) + 2)
    return first if b is None else F.concat(first, repeated(1, F.size(b) + 1))


def special_mask(a: Column, b: Column | None = None, faithful: bool = True) -> Column:
    """1 for special tokens. faithful: a pair has two marks between its sequences, though one token stands there."""
    first = F.concat(_ids(1), repeated(0, F.size(a)))
    if b is None:
        return F.concat(first, _ids(1))
    return F.concat(first, _ids(1, 1) if faithful else _ids(1), repeated(0, F.size(b)), _ids(1))


def special_mask_of(ids: Column) -> Column:
    """1 for ids of special tokens in a finished sequence."""
    return F.transform(ids, lambda x: x.isin(*SPECIALS).cast("long"))


def padded(ids: Column, length: Column, fill: int = PAD, side: str = "right") -> Column:
    more = repeated(fill, length - F.size(ids))
    return F.concat(ids, more) if side == "right" else F.concat(more, ids)


def segment_mask(ids: Column) -> Column:
    """1 for ids that are no padding."""
    return F.transform(ids, lambda x: (x > 0).cast("long"))


def pad_mask(ids: Column) -> Column:
    """1 for padding."""
    return F.transform(ids, lambda x: (x == PAD).cast("long"))


def causal_mask(n: Column) -> Column:
    """Rows of 1 for the places after a row's own."""
    places = F.sequence(F.lit(1), n)
    return F.transform(places, lambda i: F.transform(places, lambda j: (j > i).cast("int")))


def prepare(a: Column, b: Column | None, how: Strategy, side: str = "right", pad_side: str = "right", stride: int = 0, specials: bool = True, types: bool = True, overflow: bool = False, length: Column | None = None) -> Column:
    """A struct of input_ids, token_type_ids, attention_mask, special_tokens_mask, overflowing_tokens, num_truncated_tokens
    and length for one or a pair of id sequences. length: of the longest in the batch, for that padding.

    Raises ValueError where types are wanted without special tokens, or overflow of a pair cut from the longer first.
    """
    if types and not specials:
        raise ValueError("token type ids need special tokens")
    if overflow and b is not None and how.truncation == "longest_first":
        raise ValueError("what is cut from the longer of a pair is not kept")
    marks = (2 if b is None else 3) if specials else 0
    total = F.size(a) + (F.size(b) if b is not None else 0) + marks
    lost = _ids()
    if how.max_length is not None and how.truncation != "do_not_truncate":
        a, b, lost = cut_pair(a, b, total - how.max_length, how.truncation, side, stride)
    both = special(a, b) if specials else a if b is None else F.concat(a, b)
    kinds = type_ids(a, b) if specials else repeated(0, F.size(both))
    marked = special_mask(a, b) if specials else repeated(0, F.size(both))
    to = {"do_not_pad": F.size(both), "max_length": F.lit(how.max_length or 0), "longest": length if length is not None else F.size(both)}[how.padding]
    pad = lambda x, fill: padded(x, F.greatest(to, F.size(both)), fill, pad_side)
    more = repeated(1, F.greatest(to, F.size(both)) - F.size(both))
    marked = F.concat(marked, more) if pad_side == "right" else F.concat(more, marked)
    return F.struct(
        pad(both, PAD).alias("input_ids"),
        pad(kinds, 0).alias("token_type_ids"),
        pad(repeated(1, F.size(both)), 0).alias("attention_mask"),
        marked.alias("special_tokens_mask"),
        lost.alias("overflowing_tokens"),
        (total - (how.max_length or 0)).cast("long").alias("num_truncated_tokens"),
        F.greatest(to, F.size(both)).cast("long").alias("length"),
    )


def ids_of(words: DataFrame, vocab: DataFrame, keys: list[str], unknown: int = UNKNOWN) -> DataFrame:
    """keys, ids: words (keys, pos, w) as ids of a vocabulary (w, id) in their order."""
    known = words.join(vocab.select("w", "id"), "w", "left").select(*keys, "pos", F.coalesce("id", F.lit(unknown)).cast("long").alias("id"))
    return known.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def label_words(name: Column) -> Column:
    """Words of a label: blanks are underscores, between which even empty words count."""
    return F.split(F.replace(name, F.lit(" "), F.lit("_")), "_")


def tokens_of(ids: DataFrame, vocab: DataFrame, keys: list[str], without_padding: bool = False) -> DataFrame:
    """keys, words: ids (keys, ids) as words of a vocabulary; an unknown id is written in angle brackets."""
    rows = ids.select(*keys, F.posexplode("ids").alias("pos", "id"))
    rows = rows.where(F.col("id") != PAD) if without_padding else rows
    named = rows.join(vocab.select("id", "w"), "id", "left").withColumn("w", F.coalesce("w", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">"))))
    return named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("words"))


def batch_longest(rows: DataFrame, ids: Column, batch: list[str]) -> DataFrame:
    """rows with longest: the greatest length of ids in their batch."""
    return rows.withColumn("longest", F.max(F.size(ids)).over(Window.partitionBy(*batch)))


def flattened(lists: Column) -> Column:
    """Ids of lists, in a row, joined by blanks, as they are hashed."""
    return F.array_join(F.transform(F.flatten(lists), lambda x: x.cast("string")), " ")
