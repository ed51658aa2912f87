"""Operators of icspark.llm against brute force, exact round trips and held-out accuracy, with the defined odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from icspark.llm import chat, decontam, extract, langid, lines, minhash, nndescent, packing, substrings, toxicity
from icspark.llm.common import components, Held, Scratch, window_hashes

WORDS = [f"w{k}" for k in range(400)]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def roots(pairs, ids):
    up = {k: k for k in ids}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in ids}


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, null, empty, tiny and very long texts."""
    r = random.Random(5)
    base = [text(r, r.randint(60, 160)) for _ in range(30)]
    rows = list(base)
    for b in base[:10]:
        for _ in range(r.randint(1, 6)):
            w = b.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append(" ".join(w))
    passage = text(r, 70)
    rows += [f"{text(r, 20)} {passage} {text(r, 30)}" for _ in range(12)]
    rows += [base[0]] * 20 + [None, "", "one", "one", "A b C d", text(r, 20_000), " \t\n", "x\u00a0y z"]
    r.shuffle(rows)
    return [(k * 3 + 1, t, "en", "s") for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # extra columns with names that operators use inside
    return spark.createDataFrame([(*x, 1, "c") for x in corpus], "doc_id long, text string, lang string, score string, cut_lines int, rep string").repartition(5)


def empty(df):
    return df.limit(0)


def test_window_hashes():
    h = np.arange(100, dtype=np.uint64) ** 3
    for k in (1, 2, 5, 10, 20, 50, 100):
        out = window_hashes(h, k)
        assert len(out) == 101 - k and len(set(out.tolist())) == 101 - k
        assert (window_hashes(h[7:], k) == out[7:]).all()


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    found = {x.id: x.root for x in components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, {k for p in pairs for k in p})
    assert found == {k: v for k, v in want.items() if k != v}


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((250, 16))
    x[50:120] = x[50] + 0.25 * r.standard_normal((70, 16))
    x[120:140] = x[120]
    x[140] = 3 * x[120]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x.astype(np.float32))] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None], 0), (904, [], 0), (905, [float("inf")] * 16, 0), (906, [1.0], 1), (907, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = {r_.vec_id: (r_.n_links, r_.component_id, r_.kept) for r_ in nndescent.near_duplicates(df).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    a, b = np.nonzero(np.triu(y @ y.T >= 0.9, 1))
    pairs = [*zip(a.tolist(), b.tolist()), (906, 907)]
    ids = [r_[0] for r_ in rows]
    top = roots(pairs, ids)
    assert got == {k: (sum(k in p for p in pairs), top[k], top[k] == k) for k in ids}
    assert nndescent.near_duplicates(empty(df)).count() == 0


def test_substrings(docs, corpus):
    got = {r.doc_id: r for r in substrings.report(docs, with_text=True).collect()}
    starts = {}
    words = {d: [w.decode() for w in (t or "").encode().split()] for d, t, *_ in corpus}
    for d in sorted(words):
        for s in range(len(words[d]) - 49):
            starts.setdefault(tuple(words[d][s : s + 50]), d)
    removed = 0
    for d, w in words.items():
        gone = {i for s in range(len(w) - 49) if starts[tuple(w[s : s + 50])] < d for i in range(s, s + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        removed += len(gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept, got[d].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert removed > 1000 and substrings.report(empty(docs)).count() == 0


def test_minhash(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(docs).collect()}
    sets = {}
    for d, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    top = roots(pairs, ids)
    assert got == {d: (len(sets[d]), top[d], top[d] == d) for d in ids}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(top[d] == d for d in ids)
    assert minhash.groups(empty(docs)).count() == 0


def test_hot_bucket_tiles(spark, monkeypatch):
    """A group whose smallest member is like few others is resolved in tiles."""
    monkeypatch.setattr(minhash, "HOT_BUCKET", 3)
    r = random.Random(2)
    base = text(r, 150).split()
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(3 if k else 6):
            w[r.randrange(150)] = "z" + str(r.random())
        rows.append((k, " ".join(w)))
    rows.append((99, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.groups(df).collect()}
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(146)} for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == roots(pairs, list(sets))


def test_superminhash_estimates():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 600).astype(np.uint64)
    a, b = np.unique(pool[:500]), np.unique(pool[100:])
    s = minhash.signatures([a, b, a[:3], np.empty(0, np.uint64), a])
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.15 and (s[0] == s[4]).all()
    assert (s[3] == np.iinfo(np.uint64).max).all() and (s[2] < np.iinfo(np.uint64).max).all()


def test_decontamination(spark, docs, corpus, monkeypatch):
    source = {d: t for d, t, *_ in corpus if t and 60 < len(t.split()) < 200}
    picks = sorted(source)[:6]
    items = [(k, " ".join(source[d].upper().split()[10 : 10 + n]) + "!") for k, (d, n) in enumerate(zip(picks, (30, 12, 10, 9, 25, 14)))] + [(50, None), (51, "..."), (52, "one"), (53, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = {d: decontam.words_of((t or "").encode()) for d, t, *_ in corpus}

    def check():
        got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
        for d, w in words.items():
            hit, named = set(), set()
            for k, t in items:
                iw = decontam.words_of((t or "").encode())
                n = min(10, len(iw))
                grams = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
                at = [s for s in range(len(w) - n + 1) if n and tuple(w[s : s + n]) in grams]
                hit |= {i for s in at for i in range(s, s + n)}
                named |= {str(k)} if at else set()
            assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (len(w), len(hit), len(named), bool(hit))
            assert got[d].items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()

    check()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)  # several blocks give the same
    check()
    left = decontam.remove(docs, bench)
    assert left.columns == docs.columns
    assert decontam.report(left, bench).where("contaminated").isEmpty()
    assert decontam.report(docs, empty(bench)).where("contaminated").count() == 0


def test_cuts_that_join_a_benchmark_passage(spark, monkeypatch):
    """What a cut joins is cut as well, with one block and with several."""
    r = random.Random(17)
    outer, inner = text(r, 20).split(), text(r, 12)
    docs = spark.createDataFrame([(1, " ".join([*(text(r, 30).split()), *outer[:10], inner, *outer[10:], text(r, 30)])), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(outer[5:15])), (2, inner)], "item_id long, text string")
    for size in (1 << 20, 60):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        left = {x.doc_id: x.text for x in decontam.remove(docs, bench).collect()}
        assert left[2] is None and len(left[1].split()) == 70 and decontam.report(spark.createDataFrame([(1, left[1])], "doc_id long, text string"), bench).first().n_hit == 0


def test_cut_spans():
    assert decontam.without_spans("Keep, this (bad words) here.", [2, 4]) == "Keep, this ( ) here."
    assert decontam.without_spans("a b c", []) == "a b c"
    assert decontam.without_spans("a b c", [0, 3]) == ""


def test_lines(spark):
    r = random.Random(4)
    shared = [text(r, 6) for _ in range(12)]
    rows = []
    for k in range(60):
        body = [text(r, 5) for _ in range(r.randint(0, 6))]
        rows.append((k, "\n".join(body + shared[r.randint(0, 3) :] + body[:1]) if k % 3 else "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "x\ny"), (105, "x\ny")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, cut_lines int, cut_id int").repartition(4)
    out = lines.dedup(df)
    assert out.columns == df.columns
    got = {x.doc_id: x.text for x in out.collect()}
    seen, removed = set(), 0
    for d, t in sorted(rows, key=lambda x: x[0]):
        if t is None:
            assert got[d] is None
            continue
        all_, at, keep = t.split("\n"), 0, []
        for end in lines.chunk_ends([x.encode() for x in all_]):
            chunk = tuple(all_[at:end])
            if len(chunk) < 2 or chunk not in seen:
                keep += chunk
            else:
                removed += len(chunk)
            if len(chunk) > 1:
                seen.add(chunk)
            at = end
        assert got[d] == "\n".join(keep)
    assert removed > 50 and lines.report(empty(df)).count() == 0


def test_packing(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["İstanbul ΣΑΣ don't a_b x² ½ <|endoftext|>", "e\u0301a 日本語 \x1c ﬁ ß 's ª ÀÉ\u00ad®x", "A1b2!!"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = packing.pack(df, with_ids=True).collect()
    want = {d: coder.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in [*corpus, *((1000 + k, t) for k, t in enumerate(odd))]}
    back, seqs = {}, {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(back.setdefault(p.doc_id, [])) and p.length == len(p.ids) > 0 and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        back[p.doc_id] += p.ids
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert back == want
    padding = 0
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 2048 and len(s) <= packing.MAX_SEGMENTS
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0 and packing.pack(empty(df)).count() == 0


def test_token_ids_of_all_kinds_of_characters():
    """Ids equal the tokenizer's around every ASCII and Latin code point, many others, and written special tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(6)
    points = [*range(0x3100), *range(0xFB00, 0xFFFF, 7), *(r.randrange(0x3100, 0x110000) for _ in range(5000))]
    texts = [f"a{c}b 1{c}2 {c} Z{c}. .{c}q" for c in map(chr, points) if not 0xD800 <= ord(c) < 0xE000] + ["a\x01b", "x<|endoftext|>y", "<|STARTOFTEXT|> <|startoftext|>", "it's\x00 o'clock's"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordTokens(path).batch(texts)] == want


def test_packing_limits():
    r = np.random.default_rng(0)
    packer = packing.Packer(packing.Limits(100, 4, 60), 0, pool=16)
    out = []
    for k in range(200):
        n = int(r.integers(1, 90))
        out += packer.add(packing.Piece(k, 0, np.zeros(n, "<u4"), n, int(r.integers(0, n + 1))))
    out += packer.fill(0)
    by = {}
    for p, s, _ in out:
        by.setdefault(s, []).append(p)
    for ps in by.values():
        assert sum(len(p.ids) for p in ps) <= 100 and len(ps) <= 4 and sum(p.loss for p in ps) <= 60


CONTROLS = st.lists(st.sampled_from([*"\\#</turn>\n Aé", "###", "</turn>", "\\n"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    formatted = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_back(formatted)] == turns


def test_chat(spark):
    r = random.Random(7)
    rows = []
    for c in range(20):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * r.randint(1, 12)
        rows += [(c, k, role, None if r.random() < 0.05 else r.choice(["### x", "</turn>", "a\\b "]) * r.randint(0, 120)) for k, role in enumerate(roles)]
    rows += [(50, 0, None, "t"), (50, 0, None, "t"), (51, 0, "assistant", "y" * 40_000)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(df, budget=300)
    assert made.where("window > 0").count() > 10 and made.where("over_budget").count() >= 1
    got = {x.conv_id: x for x in chat.digest(made).collect()}
    for c in {x[0] for x in rows}:
        own = sorted((k, role or "", t or "") for i, k, role, t in rows if i == c)
        loss = "".join(t for _, role, t in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.windows(empty(df))).count() == 0


def test_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="ad">Buy, now, buy, now, buy, now, a long advert, with commas, and more.</div><article><h1>Head &amp; line</h1><p>First<br>para,\n graph <b>bold</b>.<p>Second&nbsp;one <a href=y>linked</a>.</p>
    <ul><li>point one<li>point two</ul><aside>side, note</aside><form><input>ask</form></article><section class="comments"><p>reader, comment, here</p></section><footer>&copy; me, you</footer></body>"""
    want = "Head & line\n\nFirst para, graph bold.\n\nSecond one linked.\n\npoint one\n\npoint two"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", "<p>" * 3000 + "deep" + "</div>" * 10), (6, "u", "<"), (7, "u", "<article><p>" + "long, text " * 20_000), (1, "u", page)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract(spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, text int")).collect())
    assert got[0] == got[1] == (1, want, len(want))
    assert got[2][1] == got[3][1] == "" and got[4][1] == "plain text only" and got[5][1] == "deep" and got[6][1] in ("", "<")
    assert got[7][2] == len("long, text " * 20_000) - 1


LONG = "A long sentence, with commas, and more of it, so that it scores. " * 6


@pytest.mark.parametrize(
    ("html", "end"),
    [
        (f"<article><div><p>{LONG}</p></div><div><p>Short end.</p></div></article>", "Short end."),
        (f"<article><p>{LONG}</p><section><h2>Head</h2><p>One.</p></section></article>", "Head\n\nOne."),
        (f"<body><section><p>{LONG}</p></section><section><h2>Head</h2><p>One.</p></section><div>&copy; me</div></body>", "Head\n\nOne."),
        (f"<body><div id=m><div><div><p>{LONG}</p></div></div><div><div><p>tail</p></div></div><ul><li><a href=x>a</a></li></ul></div></body>", "tail"),
        (f"<article><p>{LONG}</p><p class='social-science'>Kept.</p><p class='siteHeader x'>gone</p><div id=cookie-banner>gone</div></article>", "Kept."),
        (f"<body><div class=content><p>{LONG}</p>own text</div><div class='related-links'><p>gone, gone</p></div></body>", "own text"),
    ],
)
def test_whole_articles(html, end):
    assert extract.main_text(html) == f"{LONG.strip()}\n\n{end}"


def test_articles_of_the_pages_table():
    """Every page's text is its article: blocks end at p and h1, everything else inside is inline."""
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert extract.main_text(page) == "\n\n".join(x for x in blocks if x)


def test_nested_pages_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        for part in ("<div><p>t</p>", "<b>", "<td><ul>", "<div><li>x"):
            extract.main_text(part * n + "</span><div></div>" * n)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 4 * 4 * took(4_000)  # a square would be 16 times and more


def brute_kernel(s, t, n, lam):
    import itertools

    pick = lambda w: [("".join(w[i] for i in k), k[-1] - k[0] + 1) for k in itertools.combinations(range(len(w)), n)]
    return sum(lam ** (a + b) for x, a in pick(s) for y, b in pick(t) if x == y)


def test_string_kernel():
    marks, words = ["^idiot$", "^abca"], ["^i.d.iot$", "^caba$", "xyz", "ab", "^idiot$"]
    got = toxicity.Kernel(marks)(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            own = brute_kernel(w, w, 3, toxicity.DECAY) * brute_kernel(m, m, 3, toxicity.DECAY)
            assert abs(got[i, j] - (brute_kernel(w, m, 3, toxicity.DECAY) / own**0.5 if own else 0)) < 1e-5


def test_toxicity(spark):
    r = random.Random(9)
    insults = ["idiot", "moron", "loser"]
    rows = [(k, " ".join(r.choices(WORDS, k=30) + ([r.choice(insults)] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(d, t, "c") for d, t, _ in rows] + [(900, None, "c"), (901, "", "c"), (902, text(r, 20_000), "c"), (903, "you i.d.i.o.t w1", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(901, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert sum((got[d] >= 0.5) == y for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0) >= 0.97 * sum(zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows)
    assert all(got[d] < 0.5 for d in (900, 901, 902)) and all(0 <= s <= 1 for s in got.values())
    assert got[903] > got[901]
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 300 <= kept.count() <= 305
    assert toxicity.score(docs, toxicity.train(docs, empty(labels))).where("score > 0").count() == 0


@pytest.mark.parametrize(("sf", "accuracy", "precision", "recall"), [("sf0.01", 0.95, 0.95, 0.5), ("sf0.1", 0.96, 0.86, 0.82)])
def test_toxicity_of_texts_held_out(sf, accuracy, precision, recall):
    """Fitted on labelled texts that aren't held out, judged on those that are. A few labels are wrong by themselves."""
    import pyarrow.parquet as pq

    at = f"/root/testdata/{sf}"
    marks = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{at}/labels.parquet").to_pylist() if r["toxic"] is not None}
    rows = [(r["text"], marks[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in marks]
    model = toxicity.fit([t for t, _, out in rows if not out], [y for _, y, out in rows if not out])
    found = model.score(toxicity.Scorer(model).margins([t for t, _, out in rows if out])) >= 0.5
    want = np.array([y for _, y, out in rows if out]) > 0
    got = ((found == want).mean(), want[found].mean(), found[want].mean())
    print(sf, "accuracy, precision, recall:", got)
    assert got[0] >= accuracy and got[1] >= precision and got[2] >= recall


def test_sentences():
    at = lambda t: (lambda tokens, runs: (tokens, runs, sentences(tokens)))(*toxicity.tokens_of(t))
    sentences = lambda tokens: toxicity.sentences_of(tokens, list(range(len(tokens))))
    assert at(None) == ([], [], [])
    assert at("A b. cd! Long word\nmore") == (["a", "b.", "cd!", "long", "word", "more"], [(0, "abcd")], [(0, 0), (0, 0), (1, 0), (2, 0), (2, 0), (2, 0)])
    assert at("say i d i o t now")[1] == [(0, "sayidiotnow")] and at("word i d long m o")[1] == [(1, "id"), (4, "mo")]
    assert len(set(sentences(["word"] * 1000))) == -(-1000 // toxicity.SENTENCE)
    assert toxicity.bare("i.d.i.o.t!") == "idiot" and toxicity.bare("mo*ron") == "moron" and toxicity.bare("well-known-thing") == "well-known-thing"


def test_language(spark):
    r = random.Random(3)
    speak = {"en": ["the", "house", "with", "green"], "de": ["das", "haus", "mit", "grün"]}
    say = lambda lang, n: " ".join(r.choices(speak[lang], k=n))
    docs = spark.createDataFrame([(k, say(x, 30), x) for k, x in enumerate(["en", "de"] * 30)] + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    rows = [(k, f"http://h{x}.{'de' if x == 'de' else 'com'}/p", f'<html lang="{x}"><p>{say(x, 8)}</p>') for k, x in enumerate(["en", "de"] * 20)]
    rows += [(100, "http://hde.de/q", "<p></p>"), (101, None, None), (102, "::", ""), (103, "http://hde.de/q", f"<p>{say('en', 40)}</p>")]
    got = {x.page_id: x for x in langid.identify(spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, own int"), langid.train(docs)).collect()}
    assert all(got[k].lang == ["en", "de"][k % 2] for k in range(40))
    assert got[100].lang == "de" and got[103].lang == "en" and got[101].lang in ("en", "de") and got[101].host == ""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert langid.identify(empty(pages), langid.train(docs)).count() == 0
    assert langid.identify(pages, langid.train(empty(docs))).where("lang is not null").count() == 0


def test_language_posterior(spark):
    """Text, declaration, suffix and host fused by brute force, over more languages than a host sees."""
    import math
    import re

    r = random.Random(21)
    names = [f"l{a}{b}" for a in "abcdefgh" for b in "abcdefghij"]
    speak = {x: ["".join(r.choices("abcdefghij", k=4)) for _ in range(6)] for x in names}
    say = lambda x, n: " ".join(r.choices(speak[x], k=n))
    docs = spark.createDataFrame([(k, say(x, 25), x) for k, x in enumerate(names * 3)], "doc_id long, text string, lang string")
    rows = [(k, f"http://h{k % 7}.{'ab'[k % 2]}/p", f'<html lang="{x if k % 3 else "zz"}"><p>{say(x, k % 5)}</p>') for k, x in enumerate(r.choices(names[:5], k=60))] + [(None, None, None), (3, "http://h1.b/p", "<p>x</p>"), (3, "http://h1.b/p", "<p>x</p>")]
    assert langid.train(docs).languages == names and langid.dimensions_for(64) == 1 << 16 and langid.dimensions_for(1000) == 4096
    names = names[:10]
    model = langid.train(docs.where(docs.lang.isin(names)))
    got = sorted((str(x.page_id), x.host, x.declared, x.lang, x.probability) for x in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect())
    n, pages = len(names), []
    for page, url, html in rows:
        host = re.match(r"\w+://([^/]+)", url or "")
        host = host[1] if host else ""
        declared = re.search(r'lang="(\w+)"', html or "")
        tag = (declared[1] if declared[1] in names else "other") if declared else "none"
        log = model.loglik(langid.page_text(html or ""))
        own = np.exp(log - log.max()) / np.exp(log - log.max()).sum() if log.max() > log.min() else np.zeros(n)
        pages.append((page, host, host.rpartition(".")[2] if "." in host else "", tag, log, own))
    total = lambda keep: sum((p[5] for p in pages if keep(p)), np.zeros(n))
    whole = total(lambda p: True) + 1
    tags = {p[3] for p in pages}
    want = []
    for page, host, suffix, tag, log, own in pages:
        of_suffix = total(lambda p: p[2] == suffix)
        by_suffix = (of_suffix + langid.STRENGTH * whole / whole.sum()) / (of_suffix.sum() + langid.STRENGTH)
        rest = np.maximum(total(lambda p: p[1] == host) - own, 0)
        prior = (rest + langid.STRENGTH * by_suffix) / (rest.sum() + langid.STRENGTH)
        post = log + np.log(np.maximum(prior, 1e-12)) + np.log((total(lambda p: p[3] == tag) + 1 / len(tags)) / whole)
        post = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        want.append((str(page), host, tag, names[int(post.argmax())], float(post.max())))
    want.sort()
    assert [x[:4] for x in got] == [x[:4] for x in want] and all(math.isclose(a[4], b[4], abs_tol=1e-6) for a, b in zip(got, want))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_near_dedup_stage_takes_080(spark):
    """The pipeline's stage against brute force, with pairs between 0.80 and 0.85."""
    import corpus_pipeline

    r = random.Random(11)
    rows = []
    for k in range(40):
        w = text(r, 150).split()
        rows.append((2 * k, " ".join(w)))
        for at in (30, 80, 110)[: 2 + k % 2]:
            w[at] = f"z{k}"
        rows.append((2 * k + 1, " ".join(w)))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(146)} for d, t in rows}
    pairs = [(a, a + 1) for a in range(0, 80, 2) if 100 * len(sets[a] & sets[a + 1]) >= 80 * len(sets[a] | sets[a + 1])]
    assert sum(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in pairs) >= 20
    top = roots(pairs, list(sets))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in kept.collect()} == {d for d in sets if top[d] == d}
    assert minhash.banding(85) == (26, 5) and abs(minhash.least_agree(85) - 0.68) < 0.002 and minhash.least_agree(80) < 0.65


def test_nested_clusters(spark, monkeypatch):
    """Two tight clusters whose cross links lie in no list of the K best, without the exact pass."""
    monkeypatch.setattr(nndescent, "EXACT_ROWS", 0, raising=False)
    monkeypatch.setattr(nndescent, "_missed", None, raising=False)
    r = np.random.default_rng(8)
    c, d = np.linalg.qr(r.standard_normal((64, 2)))[0].T
    centres = [c, 0.93 * c + (1 - 0.93**2) ** 0.5 * d]
    x = np.concatenate([m + 0.0125 * r.standard_normal((20, 64)) for m in centres] + [r.standard_normal((60, 64))])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    sims = y @ y.T
    assert (sims[:20, 20:40] >= 0.9).mean() > 0.9
    tight = sims[:40, :40] - 2 * np.eye(40)
    assert all((np.argsort(-tight[k])[:8] < 20).all() == (k < 20) for k in range(40))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {a.vec_id: (a.n_links, a.component_id, a.kept) for a in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = (sims >= 0.9) & ~np.eye(100, dtype=bool)
    top = roots(np.argwhere(np.triu(near)).tolist(), range(100))
    assert got == {k: (int(near[k].sum()), top[k], top[k] == k) for k in range(100)}


def test_missed_vectors_are_finished(spark, monkeypatch):
    """Small groups that no table has met are found, though one hot component holds almost all links."""
    monkeypatch.setattr(nndescent, "EXACT_ROWS", 0, raising=False)
    monkeypatch.setattr(nndescent, "TABLES", 64)
    real = nndescent._seeded
    monkeypatch.setattr(nndescent, "_seeded", lambda reps, *a: real(reps.where("vec_id < 150"), *a))
    r = np.random.default_rng(12)
    x = r.standard_normal((300, 32))
    x[:150] = x[0] + 0.1 * r.standard_normal((150, 32))
    x[151:300:2] = x[150:300:2] + 0.2 * r.standard_normal((75, 32))
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = (y @ y.T >= 0.9) & ~np.eye(300, dtype=bool)
    top = roots(np.argwhere(np.triu(near)).tolist(), range(300))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {a.vec_id: (a.n_links, a.component_id) for a in nndescent.near_duplicates(df).collect()}
    assert got == {k: (int(near[k].sum()), top[k]) for k in range(300)}
    assert 64 < nndescent._tables(10_000_000) < nndescent._tables(100_000_000)


def test_links_that_a_sample_overlooks_are_found_at_any_size(spark, monkeypatch):
    """One pair that no table meets, beside many that all meet: a recall of a sample wouldn't tell."""
    monkeypatch.setattr(nndescent, "EXACT_ROWS", 0, raising=False)
    monkeypatch.setattr(nndescent, "PASS_BYTES", 10_000)  # the exact pass in several blocks
    real = nndescent._seeded
    monkeypatch.setattr(nndescent, "_seeded", lambda reps, *a: real(reps.where("vec_id < 400"), *a))
    r = np.random.default_rng(31)
    x = r.standard_normal((402, 32))
    x[1:402:2] = x[0:402:2] + 0.1 * r.standard_normal((201, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {a.vec_id: (a.n_links, a.component_id) for a in nndescent.near_duplicates(df).collect()}
    assert got == {k: (1, k - k % 2) for k in range(402)}


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks cut and drop as one does, row by row, also where an id repeats."""
    r = random.Random(13)
    items = [(k, text(r, 50)) for k in range(12)]
    rows = [(k, f"{text(r, 30)} {items[k][1]} {text(r, 30)}") for k in range(12)]
    rows += [(50 + k, f"{items[k][1]} {items[(k + 1) % 12][1]} {text(r, 8)}") for k in range(12)]
    rows += [(0, text(r, 20)), (0, items[3][1]), (90, None), (91, "")]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: (sorted(map(str, decontam.remove(docs, bench).collect())), sorted(map(str, decontam.report(docs, bench).collect())))
    one = found()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert found() == one and len(one[0]) == 15 and len(one[1]) == len(rows)


def test_toxicity_of_spaced_insults(spark):
    """Insults with spaces or line breaks between their letters score as insults."""
    r = random.Random(14)
    words = [f"word{k}" for k in range(300)] + ["a", "to", "is", "it", "of"]
    rows = [(k, " ".join(r.choices(words, k=30) + ([r.choice(["idiot", "moron", "loser"])] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(400)]
    odd = [(900, "word1 word2 i d i o t word3"), (901, "word4 id\niot word5"), (902, "word6 m o\nr o n word7"), (903, "word8 it is a word9 to it of word2")]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + odd, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all(got[d] >= 0.5 for d in (900, 901, 902)) and got[903] < 0.5
    assert all(got[d] < 0.5 for d, _, y in rows if not y)


def test_lines_of_one_id(spark):
    """Rows of one id with different texts keep their own lines."""
    r = random.Random(15)
    shared, own = ("\n".join(text(r, 6) for _ in range(40)) for _ in range(2))
    rows = [(1, shared), (5, shared), (5, own)]
    got = {(x.doc_id, len(x.text)) for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, len(shared)), (5, len(own))} < got and min(n for d, n in got if d == 5) < len(shared) / 2


def test_clean_rows_stay(spark):
    """Stages drop blank rows and rows without an id only by a decision of their own."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, ""), (None, "c d")], "doc_id long, text string")
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_benchmark):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


# ---- rows of one id, equal rows, rows without an id ----------------------------------------


@pytest.fixture(scope="module")
def odd():
    """(doc_id, text): repeated rows, several texts of an id, copies, near copies, shared passages and lines, rows without an id."""
    r = random.Random(31)
    a, b, shared = text(r, 90), text(r, 120), text(r, 60)
    near = b.split()
    near[60] = "other"
    rows = [(5, a), (2, b), (2, b), (7, a), (2, a), (9, " ".join(near)), (None, a), (None, b), (4, f"{text(r, 10)} {shared} {text(r, 5)}"), (4, f"{shared} {text(r, 9)}"), (4, f"{shared} {text(r, 9)}")]
    rows += [(6, f"{text(r, 3)}\n{shared}\n\n{text(r, 4)}"), (6, None), (6, ""), (None, None), (3, f"{text(r, 7)} {shared}")]
    return rows


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    return spark.createDataFrame([(*x, k) for k, x in enumerate(odd)], "doc_id long, text string, row int").repartition(3)


def listed(rows):
    return sorted(map(str, rows))


def test_substrings_of_odd_rows(odd_docs, odd):
    words = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in odd]
    first = {}
    for d, w in words:
        for s in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[s : s + 50])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, w in words:
        gone = {i for s in range(len(w) - 49) if d is not None and first[tuple(w[s : s + 50])] < d for i in range(s, s + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert listed(tuple(x) for x in substrings.report(odd_docs, with_text=True).collect()) == listed(want)
    assert listed(tuple(x) for x in substrings.report(odd_docs).collect()) == listed(x[:4] for x in want)


def test_substrings_write_only_tables_that_must_be(odd_docs, monkeypatch):
    real, written = Scratch.cut, []
    monkeypatch.setattr(Scratch, "cut", lambda self, df: written.append(df.columns) or real(self, df))
    substrings.report(odd_docs)
    # each file of a table on a local disk costs an executor three processes
    assert len(written) == 6
    assert sum("z" in columns for columns in written) == 1 and not any("n_words" in columns for columns in written)


def test_minhash_of_odd_rows(spark, odd_docs, odd):
    sets = []
    for _, t in odd:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    able = [k for k, (d, _) in enumerate(odd) if d is not None and sets[k]]
    pairs = [(a, b) for a in able for b in able if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    top = roots(pairs, range(len(odd)))
    smallest = {}
    for k in able:
        smallest[top[k]] = min(odd[k][0], smallest.get(top[k], odd[k][0]))
    component = [smallest.get(top[k], d) if k in able else d for k, (d, _) in enumerate(odd)]
    want = [(d, len(sets[k]), component[k], d is None or d == component[k]) for k, (d, _) in enumerate(odd)]
    assert listed(tuple(x) for x in minhash.groups(odd_docs).collect()) == listed(want)
    kept = minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(x.row for x in kept.collect()) == [k for k, x in enumerate(want) if x[3]]
    chain = spark.createDataFrame([(1, odd[0][1]), (5, odd[0][1]), (5, odd[1][1]), (7, odd[1][1])], "doc_id long, text string")
    assert listed((x.doc_id, x.text) for x in minhash.keep_one(chain).collect()) == listed([(1, odd[0][1]), (5, odd[1][1])])


def test_vectors_of_one_id(spark):
    r = np.random.default_rng(4)
    a, b, c = r.standard_normal((3, 8))
    rows = [(3, a), (1, b), (1, a), (1, a), (2, 2 * b), (None, a), (8, c), (8, c), (9, None), (None, None)]
    got = nndescent.near_duplicates(spark.createDataFrame([(d, None if v is None else v.tolist()) for d, v in rows], "vec_id long, embedding array<double>"))
    want = [(3, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (None, 0, None, True), (8, 1, 8, True), (8, 1, 8, True), (9, 0, 9, True), (None, 0, None, True)]
    assert listed(tuple(x) for x in got.collect()) == listed(want)


def test_decontamination_lines_and_packing_of_odd_rows(spark, odd_docs, odd):
    bench = spark.createDataFrame([(1, " ".join(odd[0][1].split()[5:30])), (1, None), (None, "w1")], "item_id long, text string")
    found = decontam.report(odd_docs, bench).collect()
    assert listed((x.doc_id, x.n_words) for x in found) == listed((d, len(decontam.words_of((t or "").encode()))) for d, t in odd)
    assert sum(x.n_hit >= 25 for x in found) == sum(t == odd[0][1] for _, t in odd)
    cut = decontam.remove(odd_docs, bench)
    assert cut.columns == odd_docs.columns and cut.count() == len(odd)
    lines_left = {x.row: x.text for x in lines.dedup(odd_docs).collect()}
    assert lines_left == {k: t for k, (_, t) in enumerate(odd)}  # no chunk of several lines stands in two texts
    pieces = packing.pack(odd_docs).collect()
    coder, tokens, begun = packing.coder_of(None), {}, {}
    for d, t in odd:
        tokens[str(d)] = tokens.get(str(d), 0) + len(coder.whole(t or "")) + 1
        begun[str(d)] = begun.get(str(d), 0) + 1
    assert {d: sum(p.length for p in pieces if str(p.doc_id) == d) for d in tokens} == tokens
    assert {d: sum(p.start == 0 for p in pieces if str(p.doc_id) == d) for d in begun} == begun


def test_toxicity_of_odd_rows(spark, odd_docs, odd):
    r = random.Random(9)
    rows = [(100 + k, " ".join(r.choices(WORDS, k=30) + (["idiot"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(200)]
    train_on = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(104, 1), (104, 0), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(train_on, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert listed(x.doc_id for x in got) == listed(d for d, _ in odd) and all(0 <= x.score < 0.5 for x in got)
    assert toxicity.score(empty(odd_docs), model).count() == 0
    assert toxicity.clean(odd_docs, empty(labels)).count() == len(odd)


def test_hot_groups_of_nodes(spark):
    """Components of a star, a long path and a clique that span many tasks."""
    pairs = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(300)] + [(2000 + a, 2000 + b) for a in range(25) for b in range(a)]
    found = {x.id: x.root for x in components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    want = roots(pairs, {k for p in pairs for k in p})
    assert found == {k: v for k, v in want.items() if k != v}
    with pytest.raises(RuntimeError):
        components(Scratch(spark), spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long").repartition(16), most_rounds=1)


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs):
    """Every stage answers repeated rows, rows without an id and an empty table, and keeps the columns."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = odd_docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(char_length(text) as long) AS n_chars", "row AS score")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty(docs)):
            out = stage(spark, given, sf)
            assert name == "packing" or out.columns == docs.columns, name
            assert (out.count() > 0) == (given is docs), name


def test_words_far_from_all_landmarks_are_not_compared(monkeypatch):
    """The bound passes over no word that the kernel takes to the floor, whatever repeats in it, and most words of a text."""
    r = random.Random(17)
    marks = ["^idiot$", "stra", "less$", "^aaba", "worthles", "ab"]
    kernel = toxicity.Kernel(marks)
    near = ["".join(r.choice([c, c, c, c, c + c, "", r.choice("aest.")]) for c in r.choice(marks) * r.choice([1, 1, 2])) for _ in range(3000)]
    words = sorted({toxicity.mark("".join(r.choice("abcdefghilmnoprstuw") for _ in range(r.randint(1, 20)))) for _ in range(3000)})
    for some in (near, words):
        some = [p for w in some for p in toxicity.pieces(w)]
        high, may = kernel(some).max(1) >= toxicity.FLOOR, kernel.may_reach(some, toxicity.FLOOR)
        assert not (high & ~may).any()
    assert may.mean() < 0.2
    compared = []
    real = toxicity.Kernel.__call__
    monkeypatch.setattr(toxicity.Kernel, "__call__", lambda self, w: compared.extend(w) or real(self, w))
    rows = toxicity.Rows(marks, [])
    place = rows.add(near + words)
    assert len(compared) < 0.9 * len(near) + 0.2 * len(words)
    want = np.stack([np.where((v := real(kernel, toxicity.pieces(w)).max(0)) < toxicity.FLOOR, 0, v) for w in near[:300] + words[:300]])
    assert (rows.rows[np.r_[place[:300], place[len(near) : len(near) + 300]]] == want).all()


def test_lines_free_what_other_operators_hold():
    Held.get("other", lambda: [0] * 1000)
    assert list(lines._listed(iter([]))) == [] and Held.key is None


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """Links that one task can hold become components without a written round; more of them meet in rounds, with the same result."""
    pairs = [(0, k) for k in range(1, 90)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000 + a, 2000 + b) for a in range(12) for b in range(a)] + [(3000, 3000), (5, 1000)]
    edges, want = spark.createDataFrame(pairs, "a long, b long").repartition(16), roots(pairs, {k for p in pairs for k in p})
    for together, rounds in ((len(pairs), 0), (len(pairs) - 1, 40)):
        found = components(Scratch(spark), edges, most_rounds=rounds, together=together)
        assert {x.id: x.root for x in found.collect()} == {k: v for k, v in want.items() if k != v}
    assert components(Scratch(spark), empty(edges), together=1).count() == 0
    r = random.Random(23)
    rows = []
    for k in range(24):  # chains: each text changes a word of the last
        w = list(rows[-1][1].split()) if k % 8 else text(r, 120).split()
        w[r.randrange(120)] = f"q{k}"
        rows.append((k, " ".join(w)))
    df, real, rounds = spark.createDataFrame(rows, "doc_id long, text string"), Scratch.watched, []
    monkeypatch.setattr(Scratch, "watched", lambda self, *a: rounds.append(1) or real(self, *a))
    want = [(k, k - k % 8) for k in range(24)]
    assert sorted((x.doc_id, x.component_id) for x in minhash.groups(df).collect()) == want and not rounds
    monkeypatch.setattr(minhash, "FOREST_EDGES", 1)
    assert sorted((x.doc_id, x.component_id) for x in minhash.groups(df).collect()) == want and rounds
