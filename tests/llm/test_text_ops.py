"""BPE, chat formatting, language ID, HTML extraction, mixing, sharding and top-k on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from ctxtab.llm import byte_bpe, chat_format, html_extract, language_id, mixing, sharding, topk_search
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "Hello, world! it's we'll 'S", "aaaaaaaaaaaa abababab", "<|endoftext|>a <|endoftext|><|endoftext|> b", " x  y   z\n\n\n w \t",
         "naïve 日本語テキスト 🙂🙂 ½²", "\x00\x1c\x85  ", "0123456789" * 30, " " * 40 + "x", "word" * 2000, "the theory of the thing " * 50]


def test_bpe_round_trip(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOCS).withColumn("_doc", F.lit(1))
    out = byte_bpe.decode(byte_bpe.encode(docs, digest_col="digest"))
    assert out.columns == ["doc_id", "text", "_doc", "ids", "digest", "decoded"]
    both = byte_bpe.encode(docs, decoded_col="decoded")
    assert {(r.doc_id, r.decoded) for r in both.collect()} == {(r.doc_id, r.decoded) for r in out.collect()}
    for r in out.collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.digest == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert byte_bpe.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_random_texts(library):
    r = random.Random(1)
    texts = ["".join(r.choices("ab cde'ltsr .,\n\té漢1", k=r.randrange(1, 80))) for _ in range(800)]
    encoder = byte_bpe.Encoder(byte_bpe.Vocabulary())
    for part in (texts[:300], texts[300:]):  # spans met before are used again
        assert [x.tolist() for x in encoder.encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_decode_of_broken_ids(spark, library):
    rows = spark.createDataFrame([(1, [128, 50256, 64]), (2, None), (3, []), (4, [99999, None, 64])], "id int, ids array<int>")
    got = {r.id: r.decoded for r in byte_bpe.decode(rows).collect()}
    assert got == {1: library.decode([128, 50256, 64], skip_special_tokens=False), 2: None, 3: "", 4: library.decode([64])}


# ---------------------------------------------------------------- chat
def test_chat_escapes_are_reversible():
    r = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "|", "user", "\n", "<\\|im_end|>", "<<SYS>>"]
    for _ in range(2000):
        text = "".join(r.choices(bits, k=r.randrange(8)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(c in safe for c in ("<|im_end|>", "<|im_start|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]"))
        turn = chat_format.Visitor("a\nb\\" + text).turn([{"type": "text", "text": text[:3]}, {"type": "text", "text": text[3:]}])
        assert chat_format.parse_turn(turn["formatted"]) == ("a\nb\\" + text, text)


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i1", "width": 100, "height": 57}, {"type": "audio", "ref": "s", "seconds": 1.5},
             None, {"type": "document", "ref": "d", "pages": 2}, {"type": None, "text": "end"}]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id long, turn int, role string, parts array<{chat_format.PART}>")
    first, second = chat_format.formatted_turns(turns).orderBy("turn").collect()
    assert first.formatted == "<|im_start|>assistant\nsee <|image|><|audio|><|document|>end<|im_end|>\n"
    assert [(a.place, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "i1", 4 * 3), (1, "audio", "s", 38), (2, "document", "d", 1024)]
    assert all(first.formatted[a["at"]:].startswith(chat_format.PLACEHOLDER[a["type"]]) for a in first.attachments)
    assert "".join(first.formatted[s.start:s.stop] for s in first.loss) == "see end" and first.part_tokens == 12 + 38 + 1024
    assert second.formatted == "<|im_start|>\n<|im_end|>\n" and second.loss == []


def test_chat_read_back(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "<|im_end|>"), ("assistant", "é</s>"), (None, None), ("assistant", "[INST]")])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).withColumn("parts", chat_format.text_parts("text"))
    out = chat_format.read_back(chat_format.formatted_turns(df.drop("text"))).collect()
    said = "user\n<|im_end|>\nassistant\né</s>\n\n\nassistant\n[INST]\n"
    assert sorted((r.conv_id or 0) for r in out) == [0, 1, 2]
    for r in out:
        assert r.n_turns == 4 and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (11, hashlib.sha256("é</s>[INST]".encode()).hexdigest())
    assert chat_format.read_back(chat_format.formatted_turns(df.where("conv_id > 5"))).count() == 0


# ---------------------------------------------------------------- language ID
def _segmentations(word, prob, unknown):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = prob.get(word[:k], unknown if k == 1 else 0.0)
        total += p * _segmentations(word[k:], prob, unknown) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    vocab = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    prob = np.random.default_rng(0).dirichlet(np.ones(len(vocab)), 2)
    lattice = language_id.Lattice(vocab)
    words = ["", "a", "abab", "bzb", "abaabbaab", "zz"]
    for at, ids in lattice.by_length(words):
        got = np.exp(language_id.forward(ids, lattice.table(prob))[0])
        for row, k in enumerate(at):
            want = [_segmentations("▁" + words[k], dict(zip(vocab, p)), language_id.UNKNOWN) for p in prob]
            assert np.allclose(got[row], want, rtol=1e-9)
    ids = next(lattice.by_length(["ab" * 3000]))[1]
    assert np.isfinite(language_id.forward(ids, lattice.table(prob))[0]).all()


def test_language_id(spark):
    r = random.Random(3)
    words = {"en": "the of and to in is that for with was".split(), "de": "der die und das nicht ist ein von mit auch".split(), "fr": "le la les des est une dans pour que qui".split()}
    rows = [(k, " ".join(r.choices(words[lang], k=12)), lang) for k, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !! ..", "de"), (903, "the of " * 20000, None), (None, "der die das", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(docs.where(~language_id.held_out()))
    assert model.langs == ["de", "en", "fr"]
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows[:180])
    assert [(out[k].lang_pred, out[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[903].lang_pred == "en" and out[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    empty = language_id.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


# ---------------------------------------------------------------- HTML
def _page(k, main, extra=""):
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var t='</p>'; if (a<b) x();</script></head><body class='home'>"
            f"<header><a href=/>Site</a></header><nav><ul><li>A<li>B</ul></nav><!-- <p>no</p> --><aside>Also {k}</aside><div class='cookie-notice'>We use cookies</div>"
            f"<article><h1>Title {k}</h1>{main}{extra}</article><div id='comments'><p>First! {k}</p></div><form><p>Mail <input></p></form><footer>&copy; x</footer></body></html>")


def test_html_blocks(spark):
    main = "<p>One  &amp;amp;\n two<b>bold<p>Next &lt;b&gt;<br>line<ul><li>x <i>y</i><li>z</ul><table><tr><td>c1<td>c2</table><div class=ad>Buy</div>"
    rows = [(1, "http://h.example/a", _page(1, main)), (2, None, None), (3, "http://h.example/b", ""), (4, "x", "<p>plain <nav>menu</nav> text"), (5, "http://u", "a < b &eacute; <p")]
    out = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "Title 1\nOne &amp; twobold\nNext <b>\nline\nx y\nz\nc1\nc2", 2: "", 3: "", 4: "plain\ntext", 5: "a < b é"}


def test_html_repeated_branches_go(spark):
    promo = "<section class=box><p>Read our other stories</p></section><p>Share this page now</p>"
    rows = [(k, "https://News.example:80/" + str(k), _page(k, f"<p>Story number {k} {k * 7}</p>", promo)) for k in range(12)]
    rows += [(100 + k, f"https://few.example/{k}", _page(k, "<p>same</p>")) for k in range(3)]
    rows += [(200 + k, "https://copies.example/", _page(0, "<p>one text on every page</p>")) for k in range(8)]
    out = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(out[k] == f"Title {k}\nStory number {k} {k * 7}" for k in range(12))
    assert all(out[100 + k] == f"Title {k}\nsame" for k in range(3))          # too few pages to tell
    assert all(out[200 + k] == "Title 0\none text on every page" for k in range(8))  # repetition never empties a page
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_wrappers_keep_the_article():
    article = "<article><header class='entry-header'><h1>Title</h1><p class=by>By me</p></header><p>Body text</p><div class=share>Tweet</div></article>"
    beside = "<div class=related><article><p>Another story, with a teaser that is longer</p></article></div><div id=comments><p>First!</p></div>"
    for start, end in [("<div class='site has-sidebar'>", "</div>"), ("<div class='layout no-sidebar'>", "</div>"), ("<div id='login-wrapper'>", "</div>"),
                       ("<form id=page>", "</form>"), ("<div class='post comments-open'>", "</div>"), ("<div role=dialog><div class=modal>", "</div></div>"),
                       ("<nav><p>menu<div>", "")]:
        for inner in (article, article.replace("article", "main"), f"<main>{article}</main>", f"<main class=x><div class=overlay>{article}</div></main>"):
            got = html_extract.Page(f"<body><nav>menu</nav>{start}{inner}{beside}{end}<footer>f</footer></body>").kept()
            assert got == "Title\nBody text", (start, inner, got)
    two = "".join(f"<div class='card share-on'><article><p>Story {k}</p></article></div>" for k in range(3))
    assert html_extract.Page(two).kept() == "Story 0\nStory 1\nStory 2"
    assert html_extract.Page("<article><div class='entry-header'><h2>T</h2></div><p>x</p></article>").kept() == "T\nx"


def test_html_other_articles_still_go():
    real = "<p>The page's own text without an article around it, long enough</p>"
    assert html_extract.Page(real + "<div class=related><article><p>Teaser</p></article></div>").kept() == real[3:-4]
    assert html_extract.Page(real + "<div class=newsletter><article><p>Teaser</p></article></div>").kept() == real[3:-4] + "\nTeaser"
    assert html_extract.Page(real + "<aside><article><p>Teaser</p></article></aside>").kept() == real[3:-4]
    assert html_extract.Page("<article><p>Own</p></article><div id=comments><article><p>A longer comment</p></article></div>").kept() == "Own"


def test_html_nesting_is_linear():
    import time
    t0 = time.perf_counter()
    page = html_extract.Page("<div><p>x" * 10_000 + "</q>" * 10_000)
    assert page.kept().count("x") == 10_000 and [(n.first, n.end) for n in page.nodes[:3]] == [(0, 10_000), (0, 1), (1, 10_000)]
    small = html_extract.Page("<div><p>x" * 1_000).kept()
    assert time.perf_counter() - t0 < 10 and small == "\n".join(["x"] * 1_000)  # entries for each pair of nested elements took minutes
    inline = html_extract.Page("<div><b>one<p>two</b>three</p>four</div>five")
    assert inline.kept() == "one\ntwothree\nfour\nfive"


def test_html_style_tree_against_brute_force(spark):
    import math
    import random
    from collections import Counter
    r = random.Random(4)
    rows, said, size = [], Counter(), Counter()

    def build(depth, path, seen):
        """Markup of a random element's inside, its child tags and its texts in order; fills what the page shows."""
        out, tags, texts = [], [], []
        for _ in range(r.randint(1, 3)):
            if depth == 3 or r.random() < 0.4:
                text = r.choice(["Read more stories", "All our pages", f"word {r.randint(0, 10 ** 9)}"])
                out.append(f"<p>{text}</p>")
                below, kids, tag = [text], [], "p"
                seen.add((f"{path}/p", 2, text))
            else:
                tag = r.choice(["div", "section"])
                markup, kids, below = build(depth + 1, f"{path}/{tag}", seen)
                out.append(f"<{tag}>{markup}</{tag}>")
            seen.add((f"{path}/{tag}", 0, " ".join(kids)))
            seen.add((f"{path}/{tag}", 1, "\n".join(below)))
            tags, texts = [*tags, tag], [*texts, *below]
        return "".join(out), tags, texts

    for host, pages in (("a", 30), ("b", 6), ("c", 4), ("d", 2), ("e", 1)):
        fixed = "<ul><li>Menu</li></ul><section><p>All rights reserved</p></section>"
        for _ in range(pages):
            seen = {("/ul", 0, "li"), ("/ul", 1, "Menu"), ("/ul/li", 0, ""), ("/ul/li", 1, "Menu"), ("/ul/li", 2, "Menu"),
                    ("/section", 0, "p"), ("/section", 1, "All rights reserved"), ("/section/p", 0, ""), ("/section/p", 1, "All rights reserved"),
                    ("/section/p", 2, "All rights reserved")}
            rows.append((host, fixed + build(0, "", seen)[0]))
            said.update((host, *x) for x in seen)
            size[host] += 1
    want = set()
    for host, path in {k[:2] for k in said}:
        base = math.log(size[host] + html_extract.PRIOR)
        shows, says, texts = ({k[3]: n for k, n in said.items() if k[:3] == (host, path, kind)} for kind in range(3))
        total = sum(shows.values())
        entropy = -sum(n / total * math.log(n / total) for n in shows.values()) / base
        common = sum(n * (1 - math.log(n) / base) for n in says.values()) / sum(says.values())
        weight = html_extract.GAMMA ** len(shows)
        if (1 - weight) * entropy + weight * common < html_extract.LOW and math.log(max(shows.values())) >= base * (1 - html_extract.LOW):
            want.add((host, path, None))
        want |= {(host, path, html_extract._short(t)) for t, n in texts.items() if 1 - math.log(n) / base < html_extract.LOW}
    got = html_extract.style_tree(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()
    assert {(x.host, x.path, x.feature) for x in got} == want and len(got) == len(want)
    assert {h for h, *_ in want} == {"a", "b"} and ("b", "/ul", None) in want  # little is known of what four pages share


# ---------------------------------------------------------------- mixing
def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 0})
    assert got["a"] == 30 and got["c"] == 0 and abs(sum(got.values()) - 1110) < 1e-9 and all(got[s] <= 3 * n + 1e-9 for s, n in {"b": 100, None: 1000}.items())
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_sainte_lague_is_highest_quotients():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 7)
        t, cap, seats = [r.choice([0.0, 1.0, 2.0, r.random() * 50]) for _ in range(n)], [r.randrange(0, 30) for _ in range(n)], r.randrange(0, 60)
        want = [0] * n
        for _ in range(seats):
            free = [i for i in range(n) if want[i] < cap[i] and t[i] > 0]
            if not free:
                break
            want[max(free, key=lambda i: (t[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(t), np.array(cap), seats).tolist() == want


def test_mix(spark):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.randrange(0, 60)), r.choice(["a", "b", "b", "b", "c", None, ""])) for k in range(3000)]
    rows += [(9000, None, "a"), (None, "x y z", "d"), (5, "dup dup", "a"), (5, "dup dup", "a"), (9001, "long " * 5000, "b")]
    docs = spark.createDataFrame(rows, DOCS + ", source string").withColumn("target", F.lit("clash")).repartition(3)
    out = mixing.mixed(docs).collect()
    size, taken = Counter(), Counter()
    for x in out:
        assert x["size"] == len((x.text or "").split()) and 0 <= x.taken <= 3 * x["size"]
        size[x.source] += x["size"]
        taken[x.source] += x.taken
    want = mixing.targets(dict(size))
    for s in size:
        assert abs(taken[s] - want[s]) <= 16, s
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((x.doc_id, x.taken) for x in out) == Counter((x.doc_id, x.taken) for x in again)
    made = mixing.materialised(docs)
    assert made.columns == ["doc_id", "text", "source"]
    words = defaultdict(int)
    for x in made.collect():
        words[x.doc_id] += len(x.text.split())
    assert {k: v for k, v in words.items()} == {k: v for k, v in Counter({x.doc_id: 0 for x in out}).items() | set() if v} | {
        k: v for k, v in ((d, sum(x.taken for x in out if x.doc_id == d)) for d in {x.doc_id for x in out}) if v}
    assert mixing.mixed(spark.createDataFrame([], DOCS + ", source string")).count() == 0


def test_mix_of_many_shards_keeps_to_the_targets(spark, monkeypatch):
    """Rare sources with few words for each shard of a common one, and shards that tie, miss nothing but a block."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    n, rows = 0, []
    for source, each, times in (("a", 2, 1000), ("b", 6, 1000), ("c", 12, 400), ("d", 17, 400), ("e", 40, 1500), ("f", 25, 1000), (None, 1, 3)):
        for _ in range(times):
            rows.append((n, " ".join(["w"] * each), source))
            n += 1
    rows += [(None, "w " * 7, "e")] * 300 + [(n + k, None, "e") for k in range(50)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS + ", source string").repartition(4), with_text=False).collect()
    size, taken = Counter(), Counter()
    for x in out:
        assert 0 <= x.taken <= 3 * x["size"]
        size[x.source] += x["size"]
        taken[x.source] += x.taken
    want = mixing.targets(dict(size))
    assert {s: round(want[s]) for s in want if abs(taken[s] - want[s]) > 16} == {} and len(out) == len(rows)
    assert sum(want[s] < 3 * size[s] for s in want) >= 2


# ---------------------------------------------------------------- sharding
def _check_shards(rows, out):
    n, c = len(rows), Counter(r.shard for r in out)
    assert len(out) == n and all(n // 16 <= c.get(s, 0) <= -(-n // 16) for s in range(16))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {i: (t or "").encode() for i, t in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in out)
    where = defaultdict(set)
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    return {t: len(v) for t, v in where.items()}


def test_sharding(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"pair {k // 7}" if k % 5 == 0 else f"own {k}") for k in range(1600)] + [(5000, None), (5001, ""), (None, "lost")]
    out = sharding.sharded(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    spread = _check_shards(rows, out)
    assert spread[b"hot"] <= 8                                     # 534 copies in shards of 100
    assert sum(v > 1 for t, v in spread.items() if t != b"hot") <= 3
    same = [(k % 2, "same") for k in range(37)]
    _check_shards(same, sharding.sharded(spark.createDataFrame(same, DOCS)).collect())
    assert sharding.sharded(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- top-k
def _best(vecs, k=5):
    ints = {}
    for i, v in vecs:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append(np.floor(256 * np.array(np.float32(v), float)))
    out = []
    for q in sorted(i for i in ints if i % 50 == 0):
        for qv in ints[q]:
            found = sorted((-int(qv @ c), i) for i, cs in ints.items() if i != q for c in cs if len(c) == len(qv))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return out


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 12))
    x[100:260] = x[100]                                            # one very common vector: ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, []), (1004, [1.0, 2.0]), (None, x[0].tolist()), (7, x[5].tolist())]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((q.query_id, q["rank"], q.vec_id, q.score) for q in topk_search.top_k(vecs.where("vec_id % 50 = 0"), vecs).collect())
    assert got == _best(rows)
    big = spark.createDataFrame([(0, [3e6, 1.0, 2.0]), (1, [3e6, 1.0, -2.0]), (2, [-3e6, 5.0, 1.0])], "vec_id long, embedding array<double>")
    v = [[256 * int(x) for x in y] for y in ([3e6, 1, 2], [3e6, 1, -2], [-3e6, 5, 1])]
    assert [tuple(r) for r in topk_search.top_k(big.where("vec_id = 0"), big, 2).collect()] == [(0, k, k, sum(a * b for a, b in zip(v[0], v[k]))) for k in (1, 2)]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(big.where("vec_id = 0"), big.selectExpr("vec_id", "transform(embedding, x -> x * 1e12) AS embedding")).collect()
    few = spark.createDataFrame([(0, [1.0, -2.0]), (3, [1.0, -2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(few.where("vec_id = 0"), few).collect()] == [(0, 1, 3, 256 * 256 * 5)]
    assert topk_search.top_k(few.where("vec_id > 9"), few).count() == 0


def test_lists_alone_give_the_scores():
    """Scores come from entries read; similar candidates let reading stop early, and blocks without hope are not read."""
    r = np.random.default_rng(9)
    for spread, kind in ((0.02, np.float64), (1.0, np.float64), (0.3, np.int64)):
        c = np.floor(256 * (r.standard_normal((8, 6))[np.arange(640) % 8] + spread * r.standard_normal((640, 6)))).astype(kind)
        q = np.floor(256 * r.standard_normal((9, 6))).astype(kind)
        banned = np.where(np.arange(9) % 2, -1, np.arange(9) * 7)
        lists = topk_search.Lists(c)
        got = {a: dict(zip(x.tolist(), s.tolist())) for a, x, s in topk_search.nra(q, lists, 5, banned)}
        for i in range(9):
            full = [(int(s), j) for j, s in enumerate(c @ q[i]) if j != banned[i]]
            kth = sorted(s for s, _ in full)[-5]
            assert got[i] == {j: s for s, j in full if s >= kth}
        idle = topk_search.Lists(c)
        assert topk_search.nra(q, idle, 5, banned, np.full(9, 1e15).astype(kind)) == [] and idle.read == 0
    one = topk_search.Lists(np.floor(256 * np.sort(r.standard_normal((4096, 3)), axis=0)[:, :1] * np.ones(3)))
    topk_search.nra(np.array([[256.0, 256.0, 256.0]]), one, 5, np.array([-1]))
    assert one.read <= 3 * 4096


# ---------------------------------------------------------------- all queries and the pipeline
def test_pipeline_stages_on_edges(spark):
    """Nulls, repeated rows, blank texts, no labels and empty tables pass all stages."""
    import corpus_pipeline
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (2, text, None, "a", len(text)), (2, text, None, "a", len(text)), (None, text + " more", None, None, None), (4, "12 34", None, "b", 5)]
    docs = spark.createDataFrame(rows, kind)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 3
    labelled = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en")), "")
    assert sorted((r.doc_id or 0) for r in labelled.collect()) == [0, 2, 2]
    for table in (docs, docs.where("text IS NULL")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            if name != "bpe_encoding":
                assert out.dtypes == table.dtypes, name
            out.collect()


def test_pipeline_and_queries(spark, tmp_path):
    import corpus_pipeline
    from ctxtab.llm import queries

    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes
        if name == "ngram_jaccard_join":
            from tests.llm import util
            want = util.jaccard([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "substring_dedup":
            want = util.cut([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: " ".join(x.decode() for x in util.words(r.text)) for r in docs.collect()} == {i: t for i, (n, _, t) in want.items() if t or not n}
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    assert corpus_pipeline.run(spark, SF_SMALL).count() == sizes[-1]
    assert len(queries.QUERIES) == 13 and all(any(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14))
