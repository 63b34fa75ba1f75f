"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from runlode.llm import ann, chat, decontaminate, graph, html_text, lm, mixing, pii, quality, queries, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def some_text(rng, n):
    return " ".join("".join(rng.choice(("ba", "ke", "lo", "mi", "nu")) for _ in range(rng.randint(1, 4))) for _ in range(n))


# ---- mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("names", [["a", "b", "B", "z", None, "é"] + ["hot"] * 20, ["a", "b", "c"], ["a"] * 9 + ["b", "c", None], [None]])
def test_mix_is_the_plain_computation(spark, names):
    rng = random.Random(1)
    rows = [(k, some_text(rng, rng.randint(0, 30)), rng.choice(names)) for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    target = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.size == len(WORD.findall(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position < 1
        taken[r.source] += r.taken
    assert math.isclose(sum(target.values()), sum(sizes.values()))
    assert all(target[s] - 1.001 <= taken[s] <= target[s] + 1e-6 for s in target)


def test_demand_is_inverted(spark):
    for slope in (-0.5, 0.0, 0.5):
        for share in (0.0, 0.1, 0.5, 0.999):
            t = spark.range(1).select(mixing.inverse_demand(F.lit(share), F.lit(slope))).first()[0]
            assert math.isclose((1 - slope) * t + slope * t * t, share, abs_tol=1e-12)


# ---- chat


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\im_startend>\n é", max_size=25), st.text(alphabet="<|\\>im_\n uas", max_size=20)), min_size=1, max_size=4))
def test_chat_round_trip(spark, turns):
    rows = [(1, k, role, text) for k, (text, role) in enumerate(turns)]
    shown = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = shown.select("formatted", chat.read_back(F.col("formatted")).alias("t")).first()
    assert [(x.role, x.text) for x in r.t] == [(role, text) for text, role in turns]
    assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns)


def test_loss_mask_covers_assistant_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", f"a{chat.END}"), (1, 2, "assistant", None), (1, 3, "assistant", "zé"), (2, None, None, None), (2, 1, "assistant ", "no")]
    shown = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.x for r in shown.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("x")).collect()}
    assert got == {1: f"a{chat.END}zé", 2: ""}


def test_event_log_is_folded(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "he"),
        (1, 2, 1, "delta", None, "llo"),
        (1, 3, 2, "message", "user", "more"),
        (1, 4, 3, "message", "assistant", "old"),
        (1, 5, 3, "regenerate", "assistant", None),
        (1, 6, 3, "delta", None, "ne"),
        (1, 7, 3, "delta", None, "w"),
        (2, 0, 0, "message", "user", "a"),
        (2, 1, 1, "message", "assistant", "b"),
        (2, 2, 0, "edit", None, "A"),
        (2, 3, 1, "message", "assistant", "B"),
        (2, 4, 2, "message", "user", "gone"),
        (2, 5, 1, "edit", None, "BB"),
        (3, 0, 0, "message", "user", "x"),
        (3, 1, 0, "delete", None, None),
        (4, 0, 0, "delta", "assistant", "only"),
        (4, 1, 0, "delta", None, " delta"),
    ]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got) == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "new"), (2, 0, "user", "A"), (2, 1, "assistant", "BB"), (4, 0, "assistant", "only delta")]


# ---- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>one<li>two</ul>tail", "- one\n- two\n\ntail"),
        ("<ol start=3><li>x<li>y<ul><li>z</ul></ol>", "3. x\n4. y\n   - z"),
        ("<table><tr><td>a<td>long cell<tr><td>wide one<td>b</table>", "a         long cell\nwide one  b"),
        ("<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>no</span>yes", "yes"),
        ("<head><title>t</title><style>p{}</style><script>var a='<p>';</script></head><body>x &lt;b&gt; &amp; y", "x <b> & y"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<pre>  x\n   y</pre>", "  x\n   y"),
        ("no tags  at\n all", "no tags at all"),
        ("<!-- c -->a<!-- <p>b</p> -->c", "ac"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<b>a</b><i> b</i> <u>c</u>", "a b c"),
        ("<h1>T</h1><div>x</div><div>y</div>", "T\n\nx\ny"),
        ("<table><caption>cap</caption><tr><th>漢<th>x<tr><td>ab<td>y</table>", "cap\n漢  x\nab  y"),
        ("", ""),
    ],
)
def test_pages(page, text):
    assert html_text.text_of(page) == text


def test_deep_and_broken_pages():
    assert "deep" in html_text.text_of("<div>" * 5000 + "deep")
    assert html_text.text_of("<ul>" + "<li><ul>" * 3000 + "x").endswith("x")
    assert html_text.text_of("</p></div>a<b") == "a<b"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "w1", "w2 ", "<br>", "<div>", "</div>", "<!--x-->"]), max_size=40))
def test_no_visible_word_is_lost(parts):
    page = "".join(parts)
    said = re.sub("<!--.*?-->|<[^>]*>", " ", page)
    assert Counter(re.findall(r"w\d", html_text.text_of(page))) == Counter(re.findall(r"w\d", said))


# ---- language model


def test_scores_against_brute_force(spark):
    rng = random.Random(2)
    docs = {k: some_text(rng, rng.randint(0, 60)) + (" RARE%d" % k) * (k % 3) for k in range(120)}
    learn = {k for k in docs if k % 7 != 2}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = lm.score(df, F.col("doc_id") % 7 != 2, vocabulary=40, coded=20).collect()
    tokens = {k: [*lower(t).split(), None] for k, t in docs.items()}
    c = Counter(x for k in learn for x in tokens[k])
    total, types = sum(c.values()), len(c)
    for r in got:
        base = sum(math.log10((c[x] + 1) / (total + types + 1)) for x in tokens[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(c[x] > 0 for x in tokens[r.doc_id]))
        assert r.score < 0


def small_model(words=6, classes=(0, 3)):
    names = [f"w{k}".encode() for k in range(words)]
    weights = np.full(words + 1 + lm.CLASSES, 0.5)
    weights[: words + 1] = np.arange(words + 1, 0, -1)
    m = lm.Model({w: i for i, w in enumerate(names)}, words, np.array([*map(lm.escape_class, names), 0]), np.zeros(words + 1), np.zeros(lm.CLASSES), lm.huffman(weights.tolist()), np.zeros(0))
    m.node_stretch = lm._node_stretch(m, weights)
    m.table = np.random.default_rng(1).normal(size=lm._CELLS).astype(np.float32)
    return m


def test_next_symbol_probabilities_sum_to_one():
    m = small_model()
    n = m.coded + 1 + lm.CLASSES
    context = [0, 1, 0, 2]
    before = lm.mix(m, lm.bits(m, [np.array(context)]), block=1)[0][0]
    docs = [np.array([*context, s]) for s in range(n)]
    after = lm.mix(m, lm.bits(m, docs), block=1)[0]
    assert math.isclose(sum(10 ** (after - before)), 1, abs_tol=2e-3)


def test_huffman_is_a_prefix_code():
    length, begin, node, bit = lm.huffman([5, 1, 1, 3, 0.5])
    codes = ["".join(map(str, bit[b : b + n])) for b, n in zip(begin, length, strict=True)]
    assert math.isclose(sum(2.0**-n for n in length), 1) and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_documents_do_not_touch_each_other():
    m = small_model()
    a, b = np.array([0, 1, 2, 3, 6]), np.array([3, 3, 3, 1, 6] * 900)
    alone = [lm.mix(m, lm.bits(m, [x]))[0][0] for x in (a, b)]
    assert np.allclose(lm.mix(m, lm.bits(m, [a, b, a]))[0], [alone[0], alone[1], alone[0]], rtol=1e-5)


# ---- classifiers


def test_quality_on_held_out(spark):
    rng = random.Random(3)
    rows = [(k, some_text(rng, 60) if k % 2 else " ".join([rng.choice("xyz") * 4] * 60).upper()) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality.fit(df, marks, F.col("_id") % 5 != 0)
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 1) for r in quality.score(df, model).collect() if r.doc_id % 5 == 0)


def test_nearest_neighbours_are_exact():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(80, quality.TERMS))).astype(np.float32)
    y = rng.integers(0, 2, 80)
    m = quality.train(x, y, rank=8, neighbours=7)
    e = m.embed(x[:10])
    for row, got in zip(e, m.score(x[:10]), strict=True):
        cos = m.vectors @ row
        near = np.argsort(-cos)[:7]
        w = np.exp(20 * (cos[near].astype(np.float64) - 1))
        assert math.isclose(got, (w * m.labels[near]).sum() / w.sum(), rel_tol=1e-6)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_marginals_are_brute_force(block):
    rng = np.random.default_rng(4)
    e, starts, trans, first = rng.normal(size=12) * 2, np.array([0, 1, 5]), rng.normal(size=(2, 2)), 0.4
    want = []
    for a, b in zip(starts, [*starts[1:], len(e)], strict=True):
        w = np.zeros((b - a, 2))
        for tags in product((0, 1), repeat=b - a):
            s = math.exp(first * tags[0] + sum(e[a + i] * t for i, t in enumerate(tags)) + sum(trans[p, q] for p, q in zip(tags, tags[1:], strict=False)))
            for i, t in enumerate(tags):
                w[i, t] += s
        want += list(w[:, 1] / w.sum(axis=1))
    got, pair = toxicity.forward_backward(e, starts, trans, first, block)
    assert np.allclose(got, want) and np.allclose(pair[2:5].sum(axis=1)[:, 1], got[2:5])


def test_toxic_words_and_offsets(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for k in range(400):
        w = some_text(rng, 40).split()
        if k % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["Zorgul", "frentic", "zorgulen"])
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"), F.col("_id") % 3 != 0)
    text = dict(rows)
    for r in toxicity.score(df, model).collect():
        assert (r.score >= 0.3) == (r.doc_id % 4 == 0)
        for s in r.spans:
            assert text[r.doc_id][s.start : s.end].lower() in ("zorgul", "frentic", "zorgulen")


# ---- decontamination


def brute_hits(doc, items, length):
    w = decontaminate.words(doc)
    hit, met = set(), set()
    for name, item in items:
        for win in decontaminate.windows(decontaminate.words(item), length):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    met.add(name)
    return len(w), len(hit), met


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), min_size=1, max_size=5), st.text(alphabet="abA -", max_size=120))
def test_search_is_brute_force(items, doc):
    named = [(str(k), t) for k, t in enumerate(items)]
    m = decontaminate.Matcher((w, n) for n, t in named for w in decontaminate.windows(decontaminate.words(t), 4))
    spans, met = m.search(decontaminate.words(doc))
    assert (len(decontaminate.words(doc)), decontaminate.covered(spans), met) == brute_hits(doc, named, 4)


def test_blocks_of_a_large_benchmark_agree(spark):
    rng = random.Random(6)
    bench = [(k, some_text(rng, 12)) for k in range(30)]
    docs = [(k, some_text(rng, 20) + " " + rng.choice(bench)[1] * (k % 2)) for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(map(str, decontaminate.contamination(d, b).collect()))
    many = sorted(map(str, decontaminate.contamination(d, b, block_bytes=400).collect()))
    assert one == many and any("spans=[2" in x for x in one)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_base_spans_are_brute_force(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "x.y%z@q-1.example.com", "@", ".", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "+1 (555) 123-4567", "+1", "é", "漢😀", " ", "-", "12", "0", "00000000000000", "\n", "a", "%", "+49 30 1234567"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    texts += ["1 " * 8000, "1-" * 8000 + "x", "a" * 50_000, "9" * 20_000, "+" + "1 " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df)
    named = pii.label(found, pii.fit(found))
    for r in named.select("doc_id", pii.listed(F.filter("spans", lambda x: x["base"])).alias("b")).collect():
        assert r.b == ",".join(base_spans(texts[r.doc_id])), texts[r.doc_id][:200]


def test_wider_spans_and_redaction(spark):
    texts = ["call 555-123-4567 now"] * 3 + ["mail joe [at] site [dot] org please", "card 4539/5787/6362/1486", "code=\"1234/1111/2222/3333\"", "plain text", "ask a@b.org or +1 555 123 4567.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df, keep=("text",))
    named = pii.label(found, pii.fit(found))
    got = {r.doc_id: r.t for r in named.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[0] == "call [PHONE] now" and got[3] == "mail [EMAIL] please" and got[4] == "card [CARD]"
    assert got[6] == "plain text" and got[7] == "ask [EMAIL] or [PHONE]." and got[8] is None


def test_em_finds_the_reliable_labeler():
    rng = random.Random(8)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        good = 1 if rng.random() < (0.95 if y else 0.05) else -1
        mid = 1 if rng.random() < (0.8 if y else 0.2) else -1
        weak = 1 if rng.random() < (0.65 if y else 0.35) else -1
        noise = rng.choice((1, -1))
        counts[(good, mid, weak, noise), "k|n1|d1|t"] += 1
    votes, _ = pii.estimate([(v, s, n) for (v, s), n in counts.items()])
    assert votes[0, 1] > votes[1, 1] > votes[2, 1] > votes[3, 1] >= 0


# ---- near duplicates


def fingerprint(text, width=3):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, some_text(rng, rng.randint(0, 9)).title() + rng.choice(["", "\x0b", " É", " x"])) for k in range(200)] + [(500, None), (501, "same"), (501, "same")]
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {k: fingerprint(t) for k, t in rows}
    assert len(got) == len(rows) and all(r.fp & (1 << 64) - 1 == want[r.doc_id] for r in got)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_close_pair_collides(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in combinations(range(0, 64, 3), radius):
        diff = sum(1 << b for b in bits)
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
def test_links_are_brute_force(spark, radius):
    rng = random.Random(10)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = graph.components(simhash.links(df, radius)).collect()
    m = (1 << 64) - 1
    mine = {x: x for x in fps} | {r.node & m: r.root & m for r in found}
    assert len({(root(x), mine[x]) for x in fps}) == len({root(x) for x in fps}) == len(set(mine.values()))


def test_components_of_long_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 200
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- nearest neighbours


def test_recall_and_scores(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:900] = x[500]  # a very common vector
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(v, v.where("vec_id % 50 = 0"), k=5, piece=200, query_block=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    hits = 0
    for q in range(0, 3000, 50):
        s = (d * d[q]).sum(axis=1) / (n * n[q])
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5]
        hits += len(set(want) & {k for k, _ in got[q]})
        assert all(math.isclose(s[k], score, rel_tol=1e-12) for k, score in got[q])
    assert hits / 300 >= 0.9
    assert [k for k, _ in got[600]] == [500, 501, 502, 503, 504]


# ---- the pipeline


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    bench = [(k, some_text(rng, 15)) for k in range(5)]
    rows, marks = [], []
    for k in range(240):
        good = k % 6 != 0
        text = some_text(rng, 50) if good else " ".join(["JUNK!!"] * 50)
        if k % 20 == 1:
            text += " " + bench[k % 5][1]
        if k % 20 == 3:
            text += " write to joe.doe@site.org"
        if k % 20 == 5 and k > 5:
            text = rows[k - 4][1]  # a copy of a clean document
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        marks.append((k, int(good), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {k: t for k, t, *_ in rows}
    kept = set(text)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "quality_classifier":
            kept = {k for k in kept if "JUNK" not in text[k]}
        elif name == "simhash_near_dedup":
            prints, best = {k: fingerprint(text[k]) for k in kept}, {}
            for a in sorted(kept):
                near = [b for b in best if (prints[a] ^ prints[b]).bit_count() <= 2]
                if not near:
                    best[a] = a
            kept = set(best)
        elif name == "benchmark_decontamination":
            kept = {k for k in kept if brute_hits(text[k], bench, 10)[1] == 0}
        elif name == "pii":
            assert all(r.text == re.sub(PATTERNS["email"], "[EMAIL]", text[k]) and r.n_chars == len(r.text) for k, r in got.items())
        assert set(got) == kept and kept, name
    assert [r.position for r in docs.collect() if r.position is not None]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


# ---- the thin queries

SF = "/root/testdata/sf0.001"


def test_contract_columns(spark):
    want = {
        "op1_mixing": "doc_id size source_size target taken",
        "op2_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op3_html": "page_id text",
        "op4_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op5_quality": "doc_id held_out score predicted",
        "op6_ann": "query_id rank vec_id score",
        "op7_toxicity": "doc_id held_out score predicted",
        "op8_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op10_simhash": "doc_id fingerprint component_id",
    }
    assert set(want) == set(queries.QUERIES)
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert set(columns.split()) <= set(df.columns), name
        assert df.count() > 0, name


def test_native_queries_plan_no_python(spark):
    for name in ("op1_mixing", "op2_chat", "op9_pii", "op10_simhash"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_crc_remainder(spark):
    from runlode.llm.common import remainder

    got = spark.range(100).select("id", remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)
    assert decontaminate.digest_of(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()
