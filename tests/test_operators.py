"""Operators that SQL can't express, against plain versions."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern import queries
from quern.functions import text as T
from quern.functions.abbreviations import EXPANSIONS
from quern.operators import graphs as G
from quern.operators import masking as M
from quern.operators import metrics as ME
from quern.operators import segment as S
from quern.operators import similarity as Q
from quern.operators import tables as O
from quern.plans import dataset, names, pairs

SF = "/root/testdata/sf0.001"
RUN = queries.queries()


def words_of(text):
    pattern = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|%\d?\.?\d?[sdf]|-?\d+")
    return [x for p in text.split(":") for x in (m.lower() for m in pattern.findall(p)) if not re.match(r"%(\d+(\.\d+)?)?[dfs]", x) and len(x) > 1]


def plain_instruction(line, symbols):
    """One instruction by the stated classes, a run at a time."""
    parts = re.sub(r"\s+", ", ", line.split(";")[0], count=1).split(", ")
    out = [parts[0]]
    for operand in parts[1:]:
        if parts[0] == "call":
            inner = operand.startswith(("sub", "cs:")) or "qword" in operand or "$" in operand or len(operand) <= 3
            out += ["ICALL"] if inner else ["ECALL", *words_of(operand)]
            continue
        jumps = [{"l": "LOCALJUMP" if ":" not in s else "LOCALFUN"}["l"] if s.startswith("loc_") else "RETJUMP" if s.startswith("locret_") else "short" for s in operand.split(" ") if s.startswith(("loc_", "locret_")) or s == "short"]
        if jumps:
            out += jumps
            continue
        got, negative = [], False
        for run in [s.strip() for s in re.split("([0-9A-Za-z_$]+)", operand) if s]:
            number = None
            if run == "0":
                number = ["ZERO"]
            elif run.startswith("dword_"):
                number = ["address"]
            elif run.isdigit():
                number = ["NEGATIVE" if negative else "POSITIVE"]
            else:
                m = re.fullmatch("0x([0-9a-fA-F]+)", run) or re.fullmatch("([A-F0-9]+)h", run)
                if m:
                    wide = 7 <= len(run) <= 14 if run.startswith("0x") else len(run) >= 6
                    if wide and int(m[1], 16) in symbols:
                        number = words_of(symbols[int(m[1], 16)])
                    elif wide:
                        number = ["negaddress" if negative else "address"]
                    elif len(run) < 7:
                        number = ["NEGATIVE" if negative else "POSITIVE"]
            if number:
                got += number
                negative = False
            elif run == "-" and "var_" not in run:
                got.append("+")
                negative = True
            else:
                more = ["LOCALVAR"] if "var_" in run else [run] if len(run) < 5 else words_of(run)
                if negative:
                    got[-1:] = ["-"]
                    negative = False
                got += [x for x in more if x]
        out += got
    return " ".join(out)


def test_instructions(spark):
    from quern.queries.symbols import _CODE

    e = spark.read.parquet(f"{SF}/events.parquet")
    symbols = {r[0] + 4194304: "getUser:%dName" for r in e.select("user_id").distinct().collect() if r[0] % 2 == 0}
    lines = {r["event_id"]: r["text"] for r in e.select("event_id", F.expr(_CODE).alias("text")).collect()}
    got = {r["event_id"]: r["tokens"] for r in RUN["instruction_text"](spark, SF).collect()}
    assert got == {k: plain_instruction(v, symbols) for k, v in lines.items()}


def test_entities(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in RUN["html_norm"](spark, SF).collect()}
    assert got == {k: html.unescape(html.unescape(v.replace("_", " "))).lower() for k, v in pages.items()}


def test_segmenters_over_tables(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    from quern.queries.registry import name_tokens

    counts = Counter(r["w"] for r in name_tokens(spark, SF).collect())
    known = {w: c for w, c in counts.items() if len(w) > 1 and not w.isdigit()}
    total = sum(known.values()) + len(known)
    p = {w: c / total for w, c in known.items()}
    raw = {r["p_partkey"]: r["p_name"].replace(" ", "").lower() for r in part.collect()}
    got = {r["p_partkey"]: r["parts"] for r in RUN["unigram_segment"](spark, SF).collect()}
    assert got == {k: "_".join(S.best_segmentation(s, p, size=len(p))) for k, s in raw.items()}
    top = max(counts.values())
    weights = {w: float(c) for w, c in counts.items() if c >= names.LOSS * top}
    got = {r["p_partkey"]: r["parts"] for r in RUN["lexicon_tokenize"](spark, SF).collect()}
    assert got == {k: "_".join(S.greedy_lexicon(s, S.by_letter(weights))) for k, s in raw.items()}
    after, before = defaultdict(set), defaultdict(set)
    for s in {r["p_name"].lower() for r in part.collect()}:
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 5) + 1):
                if j < len(s):
                    after[s[i:j]].add(s[j])
                if i:
                    before[s[i:j]].add(s[i - 1])
    lexicon = __import__("quern.functions.abbreviations", fromlist=["Lexicon"]).Lexicon(frozenset(w for w in counts if len(w) > 2))
    want = {}
    for k, s in raw.items():
        free = S.freedom_spans(s, {g: len(x) for g, x in after.items()}, {g: len(x) for g, x in before.items()}, S.greedy_lexicon(s, S.by_letter(weights)))
        voted = S.vote(s, S.spans_of(S.best_segmentation(s, p, size=len(p))), S.rule_spans(s, lexicon), free)
        want[k] = "_".join(x.strip() for x in voted if x.strip() and not x.isdigit())
    assert {r["p_partkey"]: r["parts"] for r in RUN["vote_split"](spark, SF).collect()} == want
    expand = lambda s: "_".join(EXPANSIONS.get(w, w) for w in s.split("_"))
    assert {r["p_partkey"]: r["words"] for r in RUN["vote_expand"](spark, SF).collect()} == {k: expand(s) for k, s in want.items()}
    f = {r["splitter"]: r["mean"] for r in RUN["splitter_f1"](spark, SF).collect()}
    assert set(f) == {"lexicon", "unigram"} and all(0 < x <= 1 for x in f.values())


def test_delimiters(spark):
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in RUN["delimiter_tokens"](spark, SF).collect():
        assert "".join(r["parts"].split("\u0001")).replace(" ", "") == texts[r["conv_id"], r["turn"]].replace("_", "").replace(" ", "")


def test_alignment_over_tables(spark):
    rows = RUN["alignment"](spark, SF).collect()
    for r in rows[:50]:
        a, b = Q.aligned(r["a"], r["b"])
        assert r["score"] == b - a and math.isclose(r["distance"], 1 / (1 + math.log(1 + b - a)), abs_tol=1e-8)
        assert r["alike"] == ((b - a) / max(len(r["a"]), len(r["b"])) > 2 / 3)


def test_masking_keeps_its_budget():
    rng = np.random.default_rng(2)
    for k in range(40):
        rows = [[3, *map(int, rng.integers(5, 90, 20)), 2, 0, 0] for _ in range(6)]
        out = M.masked(rows, f"s{k}")
        hidden = [(i, j) for i, (_, labels) in enumerate(out) for j, x in enumerate(labels) if x != M.IGNORED]
        assert all(out[i][1][j] == rows[i][j] and rows[i][j] > 4 for i, j in hidden)
        assert 0.1 < len(hidden) / 120 < 0.45 and len(hidden) <= math.ceil(120 * 0.3) + 8
        for row, (ids, labels) in zip(rows, out, strict=True):
            runs = [j for j, x in enumerate(labels) if x != M.IGNORED and (j == 0 or labels[j - 1] == M.IGNORED)]
            assert len(ids) == len(row) and ids.count(M.MASK) == len(runs)
            assert [x for x in ids if x not in (M.MASK, 0)] == [x for x, y in zip(row, labels, strict=True) if y == M.IGNORED and x]
    assert M.masked([[3, 2, 0]], "s") == [([3, 2, 0], [3, 2, 0])]
    lengths = [M.poisson(u) for u in rng.random(20_000)]
    assert abs(np.mean(lengths) - 3) < 0.05 and abs(np.var(lengths) - 3) < 0.15


def test_span_mask_query(spark):
    rows = RUN["span_mask"](spark, SF).collect()
    assert rows and all(len(r["ids"].split()) == len(r["labels"].split()) == 32 for r in rows)
    again = RUN["span_mask"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_assignments():
    assert G.assignment("rax = rbx") == ("rax", ["rbx"]) and G.assignment("call foo=1") is None and G.assignment("IRDst = x") is None
    assert G.assignment("@64[rsp + 8] = (rax + 0x1)") == ("rsp + 8", ["rax"])
    assert G.assignment("rcx = {(a1 * 32rdx)} + @32[rbp]") == ("rcx", ["a1", "rdx", "rbp"])


def plain_flow(rows, after):
    """Reaching definitions by walking every path backwards from each use."""
    blocks, before = defaultdict(list), defaultdict(set)
    for b, a, text in sorted(rows, key=lambda r: r[1]):
        blocks[b].append((a, G.assignment(text)))
    for s, d in after:
        if s != d and s in blocks and d in blocks:
            before[d].add(s)
    edges = set()
    for b, own in blocks.items():
        for k, (addr, x) in enumerate(own):
            for v in x[1] if x else []:
                here = [a for a, y in own[:k] if y and y[0] == v]
                if here:
                    edges.add((here[-1], addr))
                    continue
                seen, todo = set(), list(before[b])
                while todo:
                    p = todo.pop()
                    if p in seen:
                        continue
                    seen.add(p)
                    made = [a for a, y in blocks[p] if y and y[0] == v]
                    if made:
                        edges.add((made[-1], addr))
                    else:
                        todo += before[p]
    reached = {d for _, d in edges}
    return edges | {(G.ENTRY, a) for own in blocks.values() for a, _ in own if a not in reached}


def test_data_flow(spark):
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        rows = [(int(rng.integers(0, n)), a, f"{'abcd'[rng.integers(4)]}x = ({'abcd'[rng.integers(4)]}x + {'abcd'[rng.integers(4)]}x)") for a in range(int(rng.integers(1, 14)))]
        after = [(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(0, 8)), 2))]
        assert set(G.reaching_edges(rows, after)) == plain_flow(rows, after)
    rows = RUN["data_flow"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    text = {"click": "rax = (rbx + rcx)", "view": "@64[rsp] = rax", "purchase": "rbx = @64[rsp]"}
    by = defaultdict(list)
    for r in e:
        by[r["user_id"]].append((len(by[r["user_id"]]) // 8, r["event_id"], text.get(r["event_type"], "rcx = rbx")))
    want = set()
    for u, own in by.items():
        after = [(b, c) for b in {x[0] for x in own} for c in (b + 1, max(b - 2, 0))]
        want |= {(u, s, d) for s, d in plain_flow(own, after)}
    assert {(r["func"], r["src"], r["dst"]) for r in rows} == want


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 8))
    v[5] = v[6]
    v[7] = 0
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, v array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round((v / np.where(n > 0, n, 1)) @ (v / np.where(n > 0, n, 1)).T, 9)
    want = {}
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sim[i, j], j))[:5]
        want[i] = order
    for block in (2048, 64):
        got = defaultdict(list)
        for r in Q.nearest(df, 5, block).orderBy("a", "rk").collect():
            got[r["a"]].append(r["b"])
        assert dict(got) == want


def test_near_names_in_blocks(spark):
    df = RUN["lev_similarity"](spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_name").alias("name"))
    assert sorted(map(tuple, Q.near_names(n, block=9).collect())) == sorted(map(tuple, df.collect()))


def test_clusters_and_reports(spark):
    rows = spark.createDataFrame([(1, ["get", "name"], ["fetch", "label"]), (2, ["a", "a"], ["a", "a"]), (3, ["x"], ["y", "z"])], "id int, t array<string>, g array<string>")
    clusters = {"get": ["1"], "fetch": ["1", "2"], "name": ["3"], "label": ["3"], "x": ["4"]}
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in clusters.items() for x in kv))
    guess = ME.replaced(F.col("t"), F.col("g"), lambda w: F.try_element_at(table, w))
    counts = rows.select("id", ME.set_counts(F.col("t"), guess).alias("s")).select("id", "s.*")
    assert {r["id"]: (r["tp"], r["fp"], r["fn"]) for r in counts.collect()} == {1: (2, 0, 0), 2: (2, 0, 0), 3: (0, 2, 1)}
    r = ME.micro(counts).first()
    assert (r["tp"], r["fp"], r["fn"]) == (4, 2, 1) and math.isclose(r["p"], 4 / 6, abs_tol=1e-8) and math.isclose(r["r"], 0.8)
    zero = ME.micro(counts.where("id = 3")).first()
    assert (zero["p"], zero["r"], zero["f1"]) == (0, 0, 0)


def test_similarity_cascade(spark):
    rows = [("", ""), ("", "a"), ("getname", "name"), ("abcd", "abcf"), ("read file now", "file read"), ("zzzzzz run", "runs qqqqqq qqqqqqq")]
    df = spark.createDataFrame(rows, "a string, b string")
    words = lambda c: F.filter(F.split(c, " "), lambda x: ~x.rlike("^(.)\\1+$"))
    got = [r[0] for r in df.select(Q.similar(F.col("a"), F.col("b"), words("a"), words("b"))).collect()]
    assert got == ["empty", None, "contained", "edit", "words", "stems"]
    pairs_ = spark.createDataFrame([("k", "x", "y", 0.7), ("k", "x", "z", 0.9)], "k string, x string, y string, value double")
    side = lambda w: spark.createDataFrame([("k", w)], "k string, w string")
    assert Q.best_similarity(side("x"), side("y").unionByName(side("z")), pairs_.drop("k"), ["k"]).first()["score"] == 0.9


def test_flows(spark):
    paths = spark.createDataFrame([("/d/O0/a_b_cfg_x_y.txt",), ("/d/O0/c_cfg_x_y.txt",)], "path string")
    from quern.sources import files

    got = pairs.allowed(paths, spark.createDataFrame([("a_b",)], "name string")).collect()
    assert [tuple(r) for r in got] == [("/d/O0/a_b_cfg_x_y.txt", "/d/O0/a_b_dfg_x_y.txt")]
    r = paths.select(files.base_name(F.col("path")).alias("b"), files.folder(F.col("path")).alias("f"), files.stem(F.col("path"), 2).alias("s"), files.level_path(F.col("path"), "O3").alias("l")).first()
    assert tuple(r) == ("a_b_cfg_x_y.txt", "/d/O0", "a_b_cfg", "/d/O3/a_b_cfg_x_y.txt")
    cfg = spark.createDataFrame([("f", ["a\tb", "b\tc", "c\td"]), ("g", ["x\ty", "y\tz"])], "name string, pairs array<string>")
    dfg = spark.createDataFrame([("f", ["1\t2", "2\t3"])], "name string, pairs array<string>")
    assert [tuple(r) for r in pairs.aligned_records(cfg, dfg, ["name"]).collect()] == [("f", ["a\tb", "b\tc"], ["1\t2", "2\t3"])]
    walks = spark.createDataFrame([("w", i, t) for i, t in enumerate("abcde")] + [("v", i, t) for i, t in enumerate("xyz")], "walk string, step long, t string")
    n = {(r["left"], r["right"]): r["n"] for r in pairs.walk_pairs(walks, ["walk"], "t").collect()}
    assert n == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2, ("b", "d"): 2, ("c", "d"): 2, ("c", "e"): 2, ("d", "e"): 2}
    bodies = spark.createDataFrame([("f", "O0", [[1, 2]]), ("f", "O1", [[1, 2]]), ("f", "O2", [[3]]), ("g", "O1", [[4]])], "name string, opt string, body array<array<int>>")
    v = {(r["name"], r["opt"]) for r in dataset.variants(bodies).collect()}
    assert v == {("f", "O0"), ("f", "O2"), ("g", "O1")}
    t = dataset.training_pairs(bodies, "s").collect()
    assert Counter(r["name"] for r in t) == {"f": 5, "g": 5} and {r["class_id"] for r in t} == {1, 2}
    m = dataset.by_build(bodies, ["O0", "O1", "O2"], "body").where("name = 'g'").first()
    assert m["O0"] is None and m["O1"] == [[4]]


def test_word_vectors_and_votes(spark, tmp_path):
    from quern.sources import sinks

    rows = RUN["word2vec_syn"](spark, SF)
    assert rows.count() > 0 and rows.groupBy("word").count().agg(F.max("count")).first()[0] <= 5
    texts = spark.createDataFrame([(["a", "b", "c"],)] * 5, "words array<string>")
    model = Q.word_vectors(texts, size=4)
    sinks.save_vectors(model, f"{tmp_path}/m")
    assert sinks.load_vectors(f"{tmp_path}/m").getVectors().count() == 3
    a = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    b = spark.createDataFrame([(1, 2), (1, 4)], "a long, b long")
    assert {tuple(r) for r in Q.voted([a, b], F.col("b") == 4).collect()} == {(1, 2), (1, 4)}


def test_tables(spark):
    d = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, at long, v string")
    assert O.last_wins(d, "k", "at", "v").first()["v"] == "y"
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "block long, parent long")
    got = {r["block"]: r["owner"] for r in G.merged_blocks(chain, spark.createDataFrame([(3,), (20,)], "block long")).collect()}
    assert got == {i: None if i < 3 else 3 if i < 20 else 20 for i in range(40)}
    assert T.decoration_rules()[0][0].startswith("_+")


def test_permuted_long_texts(spark):
    """Work grows with a text's lines, not with their square: these took minutes once."""
    import hashlib
    import math
    import time

    texts = {k: [f"line {i} of {k}" for i in range(n)] for k, n in ((1, 1), (2, 2), (3, 5), (4, 3000))}

    def plain(key, s):
        dice = lambda name, i: (hashlib.md5(f"p-{name}-{key}-{i}".encode()).hexdigest(), i)
        moving = sorted(range(1, len(s) + 1), key=lambda i: dice("pick", i))[: math.ceil(len(s) * 0.5)]
        source = dict(zip(moving, sorted(moving, key=lambda i: dice("place", i)), strict=True))
        return [s[source.get(i, i) - 1] for i in range(1, len(s) + 1)]

    rows = spark.createDataFrame(list(texts.items()), "k long, s array<string>")
    t = time.time()
    got = {r["k"]: r["s"] for r in rows.select("k", M.permuted(F.col("s"), F.col("k"), "p", 0.5).alias("s")).collect()}
    assert time.time() - t < 30
    assert got == {k: plain(k, s) for k, s in texts.items()}


def test_nearest_with_ties_and_many_vectors(spark):
    """The block's top ones without sorting all of it: ties, near ties and zero vectors."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (700, 6)).astype(float)  # many equal directions
    v[350:] += rng.normal(size=(350, 6)) * 1e-7
    v[:3] = 0
    rows = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    sim = np.round(np.einsum("ik,jk->ij", u, u), 9)
    np.fill_diagonal(sim, -np.inf)
    for block in (7, 300, 5000):
        got = {(r["a"] // 3, r["rk"]): (r["b"] // 3, r["sim"]) for r in Q.nearest(rows, 5, block).collect()}
        assert len(got) == 5 * 700
        for i in range(700):
            want = np.sort(sim[i])[::-1][:5]
            assert np.allclose([got[i, k][1] for k in range(1, 6)], want, atol=1.5e-9)
            assert all(abs(sim[i, got[i, k][0]] - got[i, k][1]) < 1.5e-9 for k in range(1, 6)) and len({got[i, k][0] for k in range(1, 6)}) == 5


def test_word_vectors_stay_with_executors(spark):
    """The driver gets no vector: Spark ML's trainer sent it all of them, and failed by its memory at 313,814 words."""
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    texts = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat_ws("-", F.col("id"), i)).alias("words"))
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        assert Q.word_vectors(texts).getVectors().count() == 20_000
    finally:
        conf.set("spark.driver.maxResultSize", before)


def test_word_vectors_of_two_topics(spark, monkeypatch):
    """Words of a topic are neighbours, over several parts and passes, and reruns agree; one part is plain training."""
    from quern.operators import skipgram as K

    rng = np.random.default_rng(2)
    texts = [[f"{'ab'[k % 2]}{i}" for i in rng.integers(0, 30, 40)] for k in range(400)]
    rows = spark.createDataFrame([(x,) for x in [*texts, [], None]], "words array<string>")
    vectors = lambda **k: {r["word"]: np.array(r["v"], np.float32) for r in Q.word_vectors(rows, size=20, **k).rows.collect()}
    topics = lambda v: [max((b for b in v if b != a), key=lambda b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))[0] == a[0] for a in v]
    one = vectors()
    assert len(one) == 60 and np.mean(topics(one)) > 0.9
    monkeypatch.setattr(K, "TRAINED", 5000)
    some, again = vectors(epochs=3), vectors(epochs=3)
    assert len(some) == 60 and np.mean(topics(some)) > 0.9
    assert all((some[w] == again[w]).all() for w in some)
    assert len({tuple(x) for x in K.first_vectors([f"{i}" for i in range(9000)], 20, 1)}) == 9000


def test_skipgram_step():
    """One pair is one step of the plain formulas; a window ends with its text."""
    from quern.operators import skipgram as K

    v, u = K.first_vectors(["a", "b", "c"], 8, 1), np.full((3, 8), 0.1, np.float32)
    v0, u0 = v.astype(float), u.astype(float)
    K.train(np.array([0, 1, 2]), np.array([2, 1]), v, u, 1, (0.025, 0.025), np.random.default_rng(0))
    s = lambda x: 1 / (1 + np.exp(-x))
    rng = np.random.default_rng(0)
    order = rng.permutation(2)
    rng.integers(1, 2, 3)
    n = np.minimum(np.searchsorted(np.arange(1.0, 4), rng.random(K.SHARED) * 3, "right"), 2)
    assert len(order) == 2
    for a, b in ((0, 1), (1, 0)):  # b is guessed by a
        d = 0.025 * (1 - s(v0[a] @ u0[b])) * u0[b] - 0.025 * K.NEGATIVE / K.SHARED * sum(s(v0[a] @ u0[i]) * u0[i] for i in n if i != b)
        assert np.allclose(v[a], v0[a] + d, atol=1e-6)
    assert np.allclose(v[2], v0[2])


def test_nearest_by_tiles(monkeypatch):
    """Pairs of blocks in small tiles, against all pairs: ties, ids that repeat, and few pairs that may wait."""
    monkeypatch.setattr(Q, "TILE", (32, 64))
    monkeypatch.setattr(Q, "WAITING", 300)
    rng = np.random.default_rng(3)
    x, y = rng.integers(-2, 3, (150, 4)).astype(float), rng.standard_normal((101, 4))
    y[:50] = x[:50]
    p, q = np.sort(rng.integers(0, 140, 150)), np.arange(101) + 60
    for same in (True, False):
        ids, m = ([p, p], [x, x]) if same else ([p, q], [x, y])
        got = defaultdict(list)
        for batch in Q.best_of_blocks(ids, m, same, 5):
            for r in batch.to_pylist():
                got[r["a"]].append((-r["sim"], r["b"]))
        unit = [z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in m]
        sim = np.round(unit[0] @ unit[1].T, 9)
        want = defaultdict(list)
        for s, own, other in ((sim, *ids), (sim.T, *ids[::-1]))[: 1 if same else 2]:
            for i, a in enumerate(own.tolist()):
                want[a] += sorted((-s[i, j], b) for j, b in enumerate(other.tolist()) if b != a)[:5]
        assert got.keys() == want.keys()
        for a in want:
            g, w = np.array(sorted(got[a])), np.array(sorted(want[a]))
            assert g.shape == w.shape and np.allclose(g[:, 0], w[:, 0], atol=1.5e-9)
