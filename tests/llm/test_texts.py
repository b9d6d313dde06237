"""op2 packing, op3 fingerprints and op8 extraction: exact round trips and brute force."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from conftest import AWKWARD, SF001, frame, python_nodes, texts
from tokenizers import Tokenizer

from guestflow.llm import html, merkle, packing
from pyspark.sql import functions as F


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(t, text):
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_words_encode_as_whole_texts_do():
    t, enc, rnd = tokenizer(), packing.WordEncoder(None), random.Random(0)
    for alphabet in ("abcABC éÉñß'’.,!<|>#_ \n\t \x1cć²½ſİΣς中文٣-ßÀǅ0123", "abcABC éÉñß.,!<>#_ \nćŁž-ßÀ0123"):
        for _ in range(3000):
            x = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) + ("<|endoftext|>" if rnd.random() < 0.03 else "")
            assert enc.encode(x) + b"\0\0\0\0" == ids(t, x), repr(x)


def check_packed(rows, docs, t, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        whole, at = ids(t, text), 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            part = whole[4 * r["start"]:4 * (r["start"] + r["length"])]
            assert (r["piece"], r["start"]) == (k, at) and zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]
            at += r["length"]
        assert 4 * at == len(whole) and all(r["length"] == capacity for r in by_doc[d] if r["start"] + capacity < at)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


def test_packing_round_trip_and_fill(spark, monkeypatch):
    docs, t = texts(SF001), tokenizer()
    total = sum(len(ids(t, x)) // 4 for x in docs.values())
    for group in (20_000, 40):
        monkeypatch.setattr(packing, "GROUP_ROWS", group)
        n = check_packed(packing.pack(frame(spark, list(docs.items()))).collect(), docs, t, 2048)
        assert n <= -(-total // 2048) + (1 if group > 40 else 3)


def test_local_search_empties_bins_best_fit_leaves():
    # best fit decreasing needs three bins of ten, exchanges need two
    sizes = [6, 5, 3, 2, 2, 2]
    start = [[0, 2], [1, 3, 4], [5]]
    out = packing.local_search([list(b) for b in start], sizes, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6)) and all(sum(sizes[i] for i in b) <= 10 for b in out)
    rnd = random.Random(1)
    for _ in range(30):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 120))]
        first = packing.best_fit(sizes, 100)
        out = packing.local_search([list(b) for b in first], sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(len(sizes))) and len(out) <= len(first)
        assert all(sum(sizes[i] for i in b) <= 100 for b in out)


def test_local_search_goes_on_until_every_bin_is_stuck():
    # 150 times the case above, whose optimum is two bins each: 150 bins to empty
    sizes, start = [], []
    for k in range(150):
        start += [[6 * k, 6 * k + 2], [6 * k + 1, 6 * k + 3, 6 * k + 4], [6 * k + 5]]
        sizes += [6, 5, 3, 2, 2, 2]
    # sixty emptied bins would leave 390
    assert len(packing.local_search(start, sizes, 10)) <= 310


def test_two_go_for_one_however_many_pieces_a_bin_holds():
    most = np.zeros(206, np.int64)
    most[5] = 1
    assert packing._step({3}, list(range(65)), [3] * 65, most) == ((3, 3), 5)


def test_equal_rows_are_spread_over_packing_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    rows = packing.pack(frame(spark, [(None, "one two three")] * 400), capacity=8).collect()
    assert len(rows) == 400 and len({r["sequence_id"] >> 25 for r in rows}) > 4


def test_packing_awkward_and_empty(awkward, empty):
    rows = packing.pack(awkward).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] is not None}) >= len(AWKWARD) - 3
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2 and sum(r["doc_id"] == 5 for r in rows) == 2
    assert max(r["length"] for r in rows) == 2048
    assert packing.pack(empty).count() == 0


def twins(docs):
    order = sorted(docs, reverse=True)
    for i, d in enumerate(order):
        t, nxt = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        cut = len(t) // 3
        yield d, t, t[:len(t) - cut] + nxt[:cut], nxt


def test_fingerprints_of_documents_and_edits(spark):
    for docs in (texts(SF001), {k * 3001 - 50_000: f"para {k}\nline two {k} 😀" * (k % 5) for k in range(90)}, {5: "only one document here"}):
        df = merkle.with_next(frame(spark, list(docs.items())))
        assert not python_nodes(df)
        got = {r["doc_id"]: r for r in df.withColumn("near", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()}
        seen = {}
        for d, t, edited, nxt in twins(docs):
            r = got[d]
            assert r["edited"] == edited and r["n_chars"] == len(t)
            assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"] and seen.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
            assert seen.setdefault(nxt, r["next_fingerprint"]) == r["next_fingerprint"]
            assert (r["near"] == 1.0) == (t == edited) or r["near"] < 1
        assert len(set(seen.values())) == len(seen)


def test_next_documents_of_sparse_ids(spark):
    """Hashed 63-bit ids: nearly every id is alone in its bucket."""
    rnd = random.Random(9)
    ids = sorted({rnd.getrandbits(63) - (1 << 62) for _ in range(500)} | {7, 8, 9, 1030})
    df = merkle.with_next(frame(spark, [(d, f"text of {d}") for d in ids]))
    got = {r["doc_id"]: (r["fingerprint"], r["next_fingerprint"]) for r in df.collect()}
    assert len(got) == len(ids) and all(got[d][1] == got[ids[k - 1]][0] for k, d in enumerate(ids))
    plan = merkle.bucket_heads(df.select(F.col("doc_id").alias("k")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2  # one row per range partition, not per bucket


def test_fingerprint_tree_locates_edits(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    paras = [f"paragraph number {i} with some words in it" for i in range(60)]
    changed = paras[:41] + ["something else"] + paras[42:]
    df = spark.createDataFrame([("\n".join(paras), "\n".join(changed), "\n".join(["new"] + paras))], "a string, b string, c string")
    fp = {c: merkle.fingerprint(F.col(c)) for c in "abc"}
    r = df.select(fp["a"].alias("a"), merkle.likeness(fp["a"], fp["b"]).alias("ab"), merkle.changed_sections(fp["a"], fp["b"]).alias("s"),
                  merkle.changed_sections(fp["a"], fp["c"]).alias("i"), F.size(F.split(fp["a"], ";")).alias("n")).first()
    sections, cur = [], []
    for i, p in enumerate(paras):
        cur.append(sha(p))
        if int(sha(p)[:8], 16) % merkle.SECTION == 0 or i == len(paras) - 1:
            sections.append(sha("".join(cur)))
            cur = []
    assert r["a"][:64] == sha("".join(sections)) and r["n"] == len(sections)
    assert 0.9 < r["ab"] < 1 and 1 <= len(r["s"]) <= 2 and r["i"] in ([0], [0, 1])


def test_fingerprints_awkward_and_empty(awkward, empty):
    rows = merkle.with_next(awkward).withColumn("near", merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint"))).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["n_chars"] == 0 and by[2]["near"] == 1.0
    assert by[5]["edited"] == "Onea" and by[6]["edited"] == "OneO" and by[7]["edited"].startswith("Ünï ça 😀")
    assert merkle.with_next(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home page of the site</a></header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></li></ul></nav>
<!-- an <p>advert</p> --><div class="ad banner">Buy &amp; save a lot of money today with our great offer for you.</div>
<article><h1>The &lt;head&gt; line</h1><p><b>First   paragraph &amp; its<br>words.<p>Second&nbsp;one &copy; 2024 is <a href="x">linked</a> here
</p><p>To.</p><div class="comments"><p>A reader says that all of this is quite wrong indeed.</p></div>
<form><label>Search</label><input value="q"><button>Go</button></form><script>track()</script><aside>Related story text</aside></article>
<aside class="sidebar">Some other text of the side bar with quite a few words in it, really.</aside><footer>&copy; Us</footer>"""


def test_main_text_of_a_page():
    tree = html.trained_tree()
    assert html.main_text(PAGE, tree) == "The <head> line\n\nFirst paragraph & its words.\n\nSecond one © 2024 is linked here\n\nTo."
    for t in (None, "", "   ", "<p></p>", "<script>x", "<!-- open", "<nav>menu"):
        assert html.main_text(t, tree) == ""
    plain = "<body><div><a href=a>Menu</a></div><p>" + "words of a long paragraph " * 9 + "</p><p>" + "and then more of them " * 9 + "</p></body>"
    assert html.main_text(plain, tree).startswith("words of") and "Menu" not in html.main_text(plain, tree)


def test_labelled_blocks_are_learned():
    tree = html.trained_tree()
    rows = np.array(html.LABELLED, float)
    rows[:, 0:6:2] = np.minimum(rows[:, 0:6:2], html.LONG)
    assert all(tree.predict(r[:-1]) == r[-1] for r in rows)


ARTICLE = "<h1>Title of it</h1>" + "".join(f"<p>Sentence number {i} of the article says something that is long enough to count.</p>" for i in range(6))
ASIDE = "<div class='sidebar'><p>Some words beside the text here</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></div>"


def test_marks_and_hints_count_only_as_far_as_words_bear_them_out():
    tree = html.trained_tree()
    want = html.main_text(f"<article>{ARTICLE}</article>", tree)
    assert want.startswith("Title of it\n\nSentence number 0") and want.count("\n\n") == 6
    for page in (f"<body class='single post has-sidebar'><article>{ARTICLE}</article>{ASIDE}</body>",
                 f"<body class='home no-sidebar'><main>{ARTICLE}</main>{ASIDE}</body>",
                 f"<body><div class='content with-sidebar'>{ARTICLE}</div>{ASIDE}</body>",
                 f"<body><section class='article tag-news'><article>{ARTICLE}</article></section>{ASIDE}</body>",
                 f"<nav><a href=a>Home</a></nav><div>{ARTICLE}</div><article><h2>Read next</h2><p>Another story in a few words</p></article>",
                 f"<div>{ARTICLE}</div><div class=c><article><p>I liked this a lot, thanks!</p></article></div><footer>The end of it all</footer>",
                 f"<article>{ARTICLE}</article><div class='comments'><p>A comment of a reader</p><p>and one more of them</p></div>"):
        assert html.main_text(page, tree) == want, page


def test_links_decide_on_pages_without_a_marked_article():
    tree = html.trained_tree()
    text = "words that nobody linked to and that go on for a while here"
    links = "".join(f"<p><a href=/{i}>some linked words of a list that goes on</a></p>" for i in range(3))
    page = f"<div>{links}<p>{text}</p><p>{text}</p>{links}</div>"
    assert html.main_text(page, tree) == f"{text}\n\n{text}"
    assert html.main_text(f"<div>{links}<p>a short line among links</p>{links}</div>", tree) == ""

    def features(node):
        return {html.FEATURES[node.split[0]]} | features(node.split[2]) | features(node.split[3]) if node.split else set()

    assert {"words", "link_density", "density_before", "density_after"} <= features(tree)


def block_by_block(page, tree):
    """Brute force: each block of a flat page of <p> and <li> judged alone from its and its neighbours' texts."""
    import re
    found = re.findall(r"<(?:p|li)>(.*?)</(?:p|li)>", page)
    shape = []
    for t in found:
        words = len(re.sub("<[^>]*>", "", t).split())
        linked = sum(len(x.split()) for x in re.findall(r"<a[^>]*>(.*?)</a>", t))
        shape.append((min(words, html.LONG), linked / words))
    shape = [(0, 0.0), *shape, (0, 0.0)]
    return "\n\n".join(re.sub("<[^>]*>", "", t) for k, t in enumerate(found, 1) if tree.predict((*shape[k], *shape[k - 1], *shape[k + 1], 0, 0, 0)))


def test_flat_pages_equal_brute_force():
    tree, rnd = html.trained_tree(), random.Random(4)
    for _ in range(300):
        page = ""
        for _ in range(rnd.randint(1, 12)):
            n = rnd.choice([1, 2, 5, 12, 30, 80])
            words = [f"w{rnd.randint(0, 99)}" for _ in range(n)]
            k = rnd.randint(0, n) if rnd.random() < 0.5 else 0
            inner = (f"<a href='/x'>{' '.join(words[:k])}</a> " if k else "") + " ".join(words[k:])
            tag = rnd.choice(["p", "li"])
            page += f"<{tag}>{inner.strip()}</{tag}>"
        assert html.main_text(page, tree) == block_by_block(page, tree), page


def test_extract_rows_awkward_and_empty(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "long " * 200_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 5 and sum(r["text"] == "" for r in got) == 2 and max(len(r["text"]) for r in got) == 999_999
    assert html.extract(df.limit(0)).count() == 0
