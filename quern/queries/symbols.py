"""Queries of names and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import abbreviations as A
from quern.functions import text as T
from quern.operators import instructions as I
from quern.operators import tables as O
from quern.plans import names as P
from quern.queries.registry import CAMEL, NAMES, ident, name_tokens, query, read


@query("camel_split", f"SELECT p_partkey, array_to_string({NAMES}, '_') AS parts FROM part")
def camel_split(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(T.camel_words(ident()), "_").alias("parts"))


@query("label_vocab_ident", f"""
WITH c AS (SELECT w, count(*) AS cnt
FROM (SELECT unnest({NAMES}) AS w
FROM part)
GROUP BY w)
SELECT row_number() OVER (ORDER BY cnt DESC, w) + 3 AS id, w, cnt
FROM c""")
def label_vocab_ident(spark, d):
    return O.vocabulary(O.word_counts(name_tokens(spark, d)), 4)


_MADE = "CASE p_partkey % 7 WHEN 0 THEN '_Z' || p_name WHEN 1 THEN 'sub_' || p_partkey WHEN 2 THEN '.' || '_Zx' WHEN 3 THEN 'a_Z' || p_name WHEN 4 THEN p_name || '.cc' WHEN 5 THEN 'main' ELSE p_name END"


@query("symbol_filter", f"""
SELECT p_partkey, s
FROM (SELECT p_partkey, {_MADE} AS s
FROM part)
WHERE NOT (CASE WHEN starts_with(s, '_Z') THEN true WHEN instr(substr(s, 1, 3), '_Z') > 0 THEN NOT regexp_matches(substr(s, 1, 1), '[A-Za-z0-9]') ELSE starts_with(s, 'sub_') OR s = 'main' OR starts_with(s, '_GLOBAL_') OR ends_with(s, '.cc') OR ends_with(s, '.cpp') END)""")
def symbol_filter(spark, d):
    return read(spark, d, "part").select("p_partkey", F.expr(_MADE).alias("s")).where(~T.excluded_symbol(F.col("s")))



_OPS = """CASE event_id % 16 WHEN 0 THEN '0' WHEN 1 THEN 'loc_' || event_id WHEN 2 THEN 'loc_:' || event_id WHEN 3 THEN 'locret_1'
 WHEN 4 THEN 'dword_' || user_id WHEN 5 THEN '-' || user_id WHEN 6 THEN '0x' || hex(event_id) WHEN 7 THEN '-0x1A2B3C4D'
 WHEN 8 THEN '-0x' || hex(event_id * 40) WHEN 9 THEN hex(event_id) || 'h' WHEN 10 THEN '-' || hex(event_id * 1000) || 'h'
 WHEN 11 THEN '0x' || hex(event_id) || '000000000000' WHEN 12 THEN 'short' WHEN 13 THEN '1A2B3h' WHEN 14 THEN '-0x1A2B' ELSE 'rax' END"""


@query("operand_class", f"""
WITH o AS (SELECT event_id, {_OPS} AS op FROM events), u AS (SELECT *, regexp_replace(op, '^-', '') AS u, starts_with(op, '-') AS neg FROM o)
SELECT event_id, CASE WHEN starts_with(op, 'loc_') THEN CASE WHEN contains(op, ':') THEN 'LOCALFUN' ELSE 'LOCALJUMP' END
 WHEN op = 'short' THEN 'short' WHEN starts_with(op, 'locret_') THEN 'RETJUMP' WHEN u = '0' THEN 'ZERO' WHEN starts_with(u, 'dword_') THEN 'address'
 WHEN regexp_full_match(u, '[0-9]+') THEN CASE WHEN neg THEN 'NEGATIVE' ELSE 'POSITIVE' END
 WHEN regexp_full_match(u, '0x[0-9a-fA-F]+') AND length(u) < 7 THEN CASE WHEN neg THEN 'NEGATIVE' ELSE 'POSITIVE' END
 WHEN regexp_full_match(u, '0x[0-9a-fA-F]+') THEN CASE WHEN length(u) > 14 THEN NULL WHEN neg THEN 'negaddress' ELSE 'address' END
 WHEN regexp_full_match(u, '[A-F0-9]+h') THEN CASE WHEN length(u) >= 6 THEN CASE WHEN neg THEN 'negaddress' ELSE 'address' END
  WHEN neg THEN 'NEGATIVE' ELSE 'POSITIVE' END ELSE op END AS cls FROM u""")
def operand_class(spark, d):
    return read(spark, d, "events").select("event_id", T.operand_class(F.expr(_OPS)).alias("cls"))


_CODE = """CASE event_id % 10 WHEN 0 THEN 'mov     rax, [rbp-' || hex(user_id) || 'h]' WHEN 1 THEN 'call    sub_' || hex(event_id)
 WHEN 2 THEN 'call    printName' WHEN 3 THEN 'jmp     short loc_' || hex(event_id) WHEN 4 THEN 'add     eax, 8 ; count'
 WHEN 5 THEN 'lea     rdi, [rip+0x' || hex(4194304 + user_id) || ']' WHEN 6 THEN 'mov     [rsp-var_18], eax' WHEN 7 THEN 'push    rbp'
 WHEN 8 THEN 'cmp     dword ptr [rax - 4], 0' ELSE 'mov     edi, offset aErrorMessage' END"""


@query("instruction_text")
def instruction_text(spark, d):
    """Instructions with addresses looked up among users: tested against a plain version."""
    e = read(spark, d, "events")
    symbols = e.select("user_id").distinct().where("user_id % 2 = 0").select((F.col("user_id") + 4194304).alias("addr"), F.concat(F.lit("getUser"), F.lit(":%d"), F.lit("Name")).alias("text"))
    return I.parsed(e.select("event_id", F.expr(_CODE).alias("text")), ["event_id"], symbols)


def _nested(sql):
    """SQL that applies each rule to a text in turn."""
    for p, r in _RULES:
        sql = f"regexp_replace({sql}, '{p}', '{r}', 'g')"
    return sql


_RAW = """CASE p_partkey % 9 WHEN 0 THEN '__' || p_name || '.isra.0' WHEN 1 THEN 'sym.imp.' || p_name || '_sse2' WHEN 2 THEN p_name || '.constprop.1.cold'
 WHEN 3 THEN '12_' || p_name || '__x__' WHEN 4 THEN p_name || '_avx512_unaligned_erms' WHEN 5 THEN '..' || p_name || '.part.3.' || p_partkey WHEN 6 THEN 'sym.' || p_name || '_ssse3_' || p_partkey
 WHEN 7 THEN 'a_AB_' || p_name ELSE p_name || '___' || p_partkey END"""
#: In this dialect a run of one character is known by the character: these are all that the made names repeat.
_RULES = [x for p, r in T.decoration_rules() for x in ([("_{2,}", "_"), (r"\.{2,}", ".")] if r else [(p, r)])]


@query("strip_decorations", f"SELECT p_partkey, {_nested(f'replace({_RAW}, chr(32), chr(95))')} AS name FROM part")
def strip_decorations(spark, d):
    return read(spark, d, "part").select("p_partkey", T.stripped(F.replace(F.expr(_RAW), F.lit(" "), F.lit("_"))).alias("name"))


@query("pre_normalise", f"""
SELECT p_partkey, array_to_string(list_filter({CAMEL.replace('{}', _nested(_RAW))}, lambda x: NOT regexp_full_match(x, '[0-9]+')), ' ') AS words FROM part""")
def pre_normalise(spark, d):
    return read(spark, d, "part").select("p_partkey", T.normalised(F.expr(_RAW)).alias("words"))


@query("tool_strip", r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '__imp_', '', 'g'), '@@.*', '', 'g'), '^sym\.imp\.', ''), '^sym\.', '') AS name
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '__imp_' || p_name WHEN 1 THEN 'sym.imp.' || p_name WHEN 2 THEN 'sym.' || p_name ELSE p_name || '@@GLIBC_2.2' END AS s FROM part)""")
def tool_strip(spark, d):
    s = F.expr("CASE p_partkey % 4 WHEN 0 THEN '__imp_' || p_name WHEN 1 THEN 'sym.imp.' || p_name WHEN 2 THEN 'sym.' || p_name ELSE p_name || '@@GLIBC_2.2' END")
    return read(spark, d, "part").select("p_partkey", T.tool_stripped(s).alias("name"))


@query("html_norm")
def html_norm(spark, d):
    """Pages with entities as characters; there is no such function in SQL. Tested against the standard library."""
    return read(spark, d, "pages").select("page_id", T.unescaped(F.col("html")).alias("text"))


@query("bracket_removal", r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), '<[^<>]*>', '', 'g') AS name
FROM (SELECT p_partkey, p_name || '(int (' || p_brand || '), ' || p_type || ')<T>) end' AS s FROM part)""")
def bracket_removal(spark, d):
    s = F.concat("p_name", F.lit("(int ("), "p_brand", F.lit("), "), "p_type", F.lit(")<T>) end"))
    return read(spark, d, "part").select("p_partkey", T.without_brackets(T.without_brackets(s, "(", ")"), "<", ">").alias("name"))


_MANGLE = """CASE p_partkey % 6 WHEN 0 THEN '_ZN' || length(p_brand) || p_brand || '5countEv' WHEN 1 THEN '_Z' || length(p_brand) || p_brand || 'i_isra_0'
 WHEN 2 THEN '._ZN3foo3barEPKc.cold' WHEN 3 THEN 'x_Zname' WHEN 4 THEN p_brand ELSE '_Zunknown_part_1' END"""


@query("demangle", f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '::count' WHEN 1 THEN p_brand WHEN 2 THEN 'foo::bar' WHEN 5 THEN '_Zunknown' ELSE {_MANGLE} END AS name FROM part""")
def demangle(spark, d):
    return read(spark, d, "part").select("p_partkey", T.demangled(F.expr(_MANGLE)).alias("name"))


@query("format_words", r"""
SELECT event_id, array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all(s, '%[0-9]?[.]?[0-9]?[dfs]|-?[0-9]+|[A-Za-z]+'),
 lambda x: CASE WHEN starts_with(x, '%') THEN [x] ELSE string_split(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ') END)),
 lambda x: lower(x)), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^%([0-9]+([.][0-9]+)?)?[dfs]')), '|') AS words
FROM (SELECT event_id, 'Event%d of %5s at %2.1f and %.3s:' || event_type || 'HTTPError' || user_id || ' -' || event_id AS s FROM events)""")
def format_words(spark, d):
    s = F.concat(F.lit("Event%d of %5s at %2.1f and %.3s:"), "event_type", F.lit("HTTPError"), F.col("user_id").cast("string"), F.lit(" -"), F.col("event_id").cast("string"))
    return read(spark, d, "events").select("event_id", F.array_join(T.format_words(s), "|").alias("words"))


_KEYS, _VALUES = ("[" + ", ".join(f"'{x}'" for x in part) + "]" for part in (A.EXPANSIONS, A.EXPANSIONS.values()))


@query("abbr_expand", f"""
WITH t AS (SELECT unnest({_KEYS}) AS k, unnest({_VALUES}) AS v),
w AS (SELECT p_partkey, unnest([1, 2, 3]) AS pos, unnest([({_KEYS})[p_partkey % 149 + 1], string_split(p_name, ' ')[1], ({_KEYS})[p_partkey * 7 % 149 + 1]]) AS w FROM part)
SELECT p_partkey, string_agg(coalesce(v, w), '_' ORDER BY pos) AS parts FROM w LEFT JOIN t ON k = w GROUP BY p_partkey""")
def abbr_expand(spark, d):
    keys = F.lit(list(A.EXPANSIONS))
    at = lambda c: F.element_at(keys, (c % 149 + 1).cast("int"))
    words = F.array(at(F.col("p_partkey")), F.split("p_name", " ")[0], at(F.col("p_partkey") * 7))
    return read(spark, d, "part").select("p_partkey", F.array_join(T.expand(words, A.EXPANSIONS), "_").alias("parts"))


@query("lemma_join", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
l AS (SELECT DISTINCT w, regexp_replace(w, '(e|ed|s)$', '') AS lemma FROM w WHERE regexp_matches(w, '(e|ed|s)$') AND w <> 'rose')
SELECT p_partkey, string_agg(CASE WHEN w = 'the' THEN w ELSE coalesce(lemma, w) END, ' ' ORDER BY pos) AS words FROM w LEFT JOIN l USING (w) GROUP BY p_partkey""")
def lemma_join(spark, d):
    w = read(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "w"))
    lemmas = w.select("w").distinct().where(F.col("w").rlike("(e|ed|s)$") & (F.col("w") != "rose")).select("w", F.lit("n").alias("tag"), F.regexp_replace("w", "(e|ed|s)$", "").alias("lemma"))
    out = P.lemmatised(w, lemmas, ["p_partkey"], ("the",))
    return out.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("words"))


@query("clean_tokens", r"""
SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: NOT contains(x, '<')),
 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_full_match(x, '\p{Nd}+')), ' ') AS words FROM conversations""")
def clean_tokens(spark, d):
    words = T.without_digits(T.without_angles(T.spaced_words(F.col("text"))))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query("alnum_set", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_type || '-' || p_name || '_' || p_brand), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS words FROM part""")
def alnum_set(spark, d):
    name = F.concat("p_type", F.lit("-"), "p_name", F.lit("_"), "p_brand")
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.alphanumeric_set(name)), " ").alias("words"))


@query("lexicon_lines", """
SELECT w, count(*) AS cnt FROM (SELECT unnest(string_split_regex(lower(replace(p_name || ' ' || p_type || '_' || p_size, '_', ' ')), '[ \\t\\n\\r]+')) AS w FROM part)
WHERE length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') GROUP BY w""")
def lexicon_lines(spark, d):
    line = F.concat("p_name", F.lit(" "), "p_type", F.lit("_"), F.col("p_size").cast("string"))
    return O.word_counts(read(spark, d, "part").select(F.explode(T.lexicon_words(line)).alias("w")))


@query("without_item", "SELECT user_id, array_to_string(list_filter(list_sort(list(event_type)), lambda x: x <> 'click'), ',') AS types FROM events GROUP BY user_id")
def without_item(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_remove(F.array_sort(F.collect_list("event_type")), "click"), ",").alias("types"))
