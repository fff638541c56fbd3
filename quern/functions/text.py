"""Text expressions: name splitting, symbol filters, decorations, operand classes. Built-in functions, but where noted."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places inside an identifier where one word ends and the next begins.
BORDER = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def camel_words(name: Column, keep_digits: bool = False, least: int = 1) -> Column:
    """Lower-cased parts of a camel-case identifier."""
    parts = F.transform(F.split(F.regexp_replace(name, BORDER, " "), "[^A-Za-z0-9]+"), F.lower)
    return F.filter(parts, lambda x: (F.lit(keep_digits) | ~x.rlike("^[0-9]*$")) & (F.length(x) >= max(least, 1)))


def format_words(text: Column) -> Column:
    """Words and signed numbers of a text with format specifications: whole ones (%d, %3s, %2.1f) and single characters go."""
    found = F.regexp_extract_all(text, F.lit("%[0-9]?[.]?[0-9]?[dfs]|-?[0-9]+|[A-Za-z]+"), 0)
    parts = lambda x: F.when(x.startswith("%"), F.array(x)).otherwise(F.split(F.regexp_replace(x, BORDER, " "), " "))
    words = F.transform(F.flatten(F.transform(found, parts)), F.lower)
    return F.filter(words, lambda x: (F.length(x) > 1) & ~x.rlike("^%([0-9]+([.][0-9]+)?)?[dfs]"))


#: How names that compilers and tools make up begin and end.
MANGLED = "_Z"
MADE_STARTS, MADE_ENDS, MADE_NAMES = ("sub_", "_GLOBAL_"), (".cc", ".cpp"), ("main",)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def excluded_symbol(name: Column) -> Column:
    """Whether a symbol is compiler-made. One with the mark of mangling near its start is judged by its first character."""
    near = F.locate(MANGLED, F.substring(name, 1, 3)) > 0
    word = F.substring(name, 1, 1).rlike("[A-Za-z0-9]")
    made = _any([name.startswith(s) for s in MADE_STARTS] + [name.endswith(s) for s in MADE_ENDS] + [name.isin(*MADE_NAMES)])
    return F.when(name.startswith(MANGLED), True).when(near, ~word).otherwise(made)


def kept_segment(name: Column) -> Column:
    """Whether a segment holds code: by the second and third character of its name."""
    return F.substring(name, 2, 2).isin("OA", "OM", "te")


def without_made(names: Column) -> Column:
    """An array of names without tool-made and empty ones."""
    return F.filter(names, lambda x: ~x.startswith("sub_") & (x != ""))


def spaced_words(text: Column) -> Column:
    """Words between blanks, tabs and line ends; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda x: x != "")


def vocabulary_words(line: Column, keep_digits: bool = False) -> Column:
    """Words of a line of a corpus; a word of digits goes."""
    return F.filter(spaced_words(line), lambda x: F.lit(keep_digits) | ~x.rlike("^[0-9]+$"))


def lexicon_words(line: Column, least: int = 2) -> Column:
    """Lower-cased words of a line, underscores being blanks; words of digits and shorter ones go."""
    return F.filter(spaced_words(F.lower(F.replace(line, F.lit("_"), F.lit(" ")))), lambda x: ~x.rlike("^[0-9]+$") & (F.length(x) >= least))


def without_angles(words: Column) -> Column:
    """Words without those that hold an angle bracket, as special tokens do."""
    return F.filter(words, lambda x: ~x.contains("<"))


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_digits(words: Column) -> Column:
    """Trimmed words without blank ones and numbers in digits of any script."""
    return F.filter(F.transform(words, trimmed), lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$"))


def blank_stripped(tokens: Column) -> Column:
    """Lower-cased tokens, split at white space, without blank ones."""
    return F.filter(F.flatten(F.transform(tokens, lambda x: F.split(F.lower(x), r"\s+"))), lambda x: x != "")


def alphanumeric_set(name: Column) -> Column:
    """Distinct runs of letters and digits of a lower-cased name, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != ""))


def underscored(words: Column) -> Column:
    """Words joined by underscores, blanks inside them too."""
    return F.replace(F.array_join(words, "_"), F.lit(" "), F.lit("_"))


def fixed_decimals(value: Column, decimals: int) -> Column:
    """A number as text with so many decimals; halves go to the even digit."""
    return F.format_string(f"%.{decimals}f", F.bround(value.cast("double"), decimals))


def unescaped(text: Column) -> Column:
    """HTML entities as characters, twice; underscores as blanks; lower case. A pandas function: there is no built-in."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(html.unescape(x.replace("_", " "))).lower())

    return run(text)


def without_brackets(text: Column, left: str, right: str) -> Column:
    """text without what stands in balanced brackets; a right bracket with no partner stays."""
    step = lambda s, c: (
        F.when(c == left, F.struct((s["depth"] + 1).alias("depth"), s["out"].alias("out")))
        .when((c == right) & (s["depth"] > 0), F.struct((s["depth"] - 1).alias("depth"), s["out"].alias("out")))
        .when(s["depth"] == 0, F.struct(s["depth"].alias("depth"), F.concat(s["out"], c).alias("out")))
        .otherwise(s)
    )
    return F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)["out"]


# decorations of library symbols --------------------------------------------------------------------------------------

#: Fixed values, in the order they are taken out: marks of variants of a function.
VARIANTS = [r"_+[A-Z]{1,2}_+", r"_ssse\d*", r"_sse\d*", r"avx\d*", r"\.cold$", "unaligned", "erms", r"\.constprop(\.\d*)*", r"\.constp(\.\d*)*", r"\.isra(\.\d*)*", r"\.part(\.\d*)*"]
#: Fixed values, taken out after each of those: what tools put before and after a name.
EDGES = [r"^sym\.imp\.", r"^sym\.", r"\.+\d+$", r"_+\d+$", r"^\d+_+", r"^\.+", r"\.+$", "^_+", "_+$", r"^\d+"]
#: A run of one character that is no letter or digit.
REPEATED = "([^a-zA-Z0-9])\\1+"


def decoration_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) in the order of application."""
    return [rule for v in VARIANTS for rule in ((v, ""), *((e, "") for e in EDGES), (REPEATED, "$1"))]


def stripped(name: Column) -> Column:
    """A symbol without the decorations of compilers, libraries and tools.

    The rules are rows of a literal array, which a fold applies: a nested expression would be too large to compile.
    """
    rules = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in decoration_rules()))
    return F.aggregate(rules, name, lambda s, x: F.regexp_replace(s, x["p"], x["r"]))


def tool_stripped(name: Column) -> Column:
    """A symbol without the marks of one disassembler's imports and data references, and another's prefixes."""
    for pattern in ("__imp_", "@@.*", r"^sym\.imp\.", r"^sym\."):
        name = F.regexp_replace(name, pattern, "")
    return name


def normalised(name: Column, keep_digits: bool = False) -> Column:
    """Words of a raw symbol, joined by blanks: stripped of decorations, split, lower-cased."""
    return F.array_join(camel_words(stripped(name), keep_digits), " ")


#: What compilers append to copies of a function, once dots have become underscores.
CLONES = ["_isra_", "_part_", "_constprop_"]


def itanium_name(symbol: Column) -> Column:
    """The qualified name in a mangled symbol that is made of plain or nested names; null for any other."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if not x or not x.startswith(MANGLED):
                return None
            at, out = len(MANGLED), []
            nested = x[at : at + 1] == "N"
            at += nested
            while at < len(x) and x[at].isdigit():
                end = at
                while end < len(x) and x[end].isdigit():
                    end += 1
                n = int(x[at:end])
                if end + n > len(x):
                    return None
                out.append(x[end : end + n])
                at = end + n
                if not nested:
                    break
            return "::".join(out) or None if not nested or x[at : at + 1] == "E" else None

        return s.map(one)

    return run(symbol)


def demangled(symbol: Column, demangle=itanium_name) -> Column:
    """A mangled symbol's name, without parameters; other symbols stay.

    demangle: a column function that gives null for what it can't read. What follows a dot or at sign is not asked about.
    Then what compilers append to copies is cut off, and last parts are left away, up to two, until the rest can be read.
    """
    near = F.locate(MANGLED, F.substring(symbol, 1, 3)) > 0
    word = F.substring(symbol, 1, 1).rlike("[A-Za-z0-9]")
    own = F.when(symbol.startswith(MANGLED), symbol).when(near & ~word, F.substring(symbol, 2, 1 << 30))
    cut = own
    for mark in CLONES:
        cut = F.substring_index(cut, mark, 1)
    parts = F.split(cut, "_")
    tries = [F.regexp_extract(own, "^[^.@]*", 0), cut, *(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - k, F.lit(0))), "_") for k in (1, 2))]
    name = F.coalesce(*(demangle(t) for t in tries), cut)
    for left, right in ("()", "<>"):
        name = without_brackets(name, left, right)
    return F.when(own.isNull(), symbol).otherwise(name)


# operands -----------------------------------------------------------------------------------------------------------

#: The classes of operands, and the lengths of a hexadecimal number that decide between them.
ZERO, ADDRESS, NEGATIVE_ADDRESS, POSITIVE, NEGATIVE = "ZERO", "address", "negaddress", "POSITIVE", "NEGATIVE"
JUMP, FAR_JUMP, RETURN_JUMP, VARIABLE = "LOCALJUMP", "LOCALFUN", "RETJUMP", "LOCALVAR"
INTERNAL_CALL, EXTERNAL_CALL = "ICALL", "ECALL"
PREFIXED_ADDRESS, LONGEST_ADDRESS, SUFFIXED_ADDRESS = 7, 14, 6


def is_hex(text: Column) -> Column:
    """Whether a text is a hexadecimal number in capitals that ends in h."""
    return text.rlike("^[A-F0-9]+h$")


def address_of(text: Column) -> Column:
    """The number that an operand long enough for an address stands for, as a long; null if it is none."""
    prefixed = text.rlike("^0x[0-9a-fA-F]+$") & F.length(text).between(PREFIXED_ADDRESS, LONGEST_ADDRESS)
    suffixed = is_hex(text) & (F.length(text) >= SUFFIXED_ADDRESS) & (F.length(text) <= 16)
    digits = F.when(prefixed, F.substring(text, 3, 20)).when(suffixed, F.regexp_replace(text, "h$", ""))
    return F.conv(digits, 16, -10).cast("long")


def number_class(text: Column, negative: Column) -> Column:
    """Class of an unsigned number; null for what is none, and for prefixed numbers beyond an address's length."""
    sign = F.when(negative, NEGATIVE).otherwise(POSITIVE)
    wide = F.when(negative, NEGATIVE_ADDRESS).otherwise(ADDRESS)
    prefixed = text.rlike("^0x[0-9a-fA-F]*$")
    return (
        F.when(text == "0", ZERO)
        .when(text.startswith("dword_"), ADDRESS)
        .when(text.rlike(r"^\p{Nd}+$"), sign)
        .when(prefixed & (F.length(text) < PREFIXED_ADDRESS), sign)
        .when(prefixed & (F.length(text) <= LONGEST_ADDRESS), wide)
        .when(is_hex(text), F.when(F.length(text) >= SUFFIXED_ADDRESS, wide).otherwise(sign))
    )


def jump_classes(operand: Column) -> Column:
    """Classes of an operand's jump targets, in order; other words of it have none."""
    one = lambda x: (
        F.when(x.startswith("loc_"), F.when(x.contains(":"), FAR_JUMP).otherwise(JUMP)).when(x == "short", x).when(x.startswith("locret_"), RETURN_JUMP)
    )
    return F.filter(F.transform(F.split(operand, " "), one), lambda x: x.isNotNull())


def call_classes(operand: Column, words=format_words) -> Column:
    """Class of a call's target, with the words of its name if it is an external one."""
    inner = operand.startswith("sub") | operand.startswith("cs:") | operand.contains("qword") | operand.contains("$") | (F.length(operand) <= 3)
    outer = F.concat(F.array(F.lit(EXTERNAL_CALL)), F.flatten(F.transform(F.split(operand, ":"), words)))
    return F.when(inner, F.array(F.lit(INTERNAL_CALL))).otherwise(outer)


def operand_class(op: Column) -> Column:
    """Class of a single operand with its sign: a jump target's or a number's; others stay."""
    digits = F.regexp_replace(op, "^-", "")
    return F.coalesce(F.get(jump_classes(op), 0), number_class(digits, op.startswith("-")), F.when(~digits.rlike("^0x[0-9a-fA-F]{13,}$"), op))


def expand(words: Column, table: dict[str, str]) -> Column:
    """Abbreviations to their words; an entry may be several words joined by underscores."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(m, w), w), "_")))


def weighted_line(line: Column, log: bool = True) -> Column:
    """A struct of word and weight from a line: fields part at tabs, blanks, commas and semicolons; log10(1 + weight), or the
    weight as it is; 1 where there is none."""
    fields = F.split(line, "[\t ,;\n\r]")
    weight = F.get(fields, 1).try_cast("double")
    return F.struct(F.get(fields, 0).alias("word"), F.coalesce(F.log10(weight + 1) if log else weight, F.lit(1.0)).alias("weight"))
