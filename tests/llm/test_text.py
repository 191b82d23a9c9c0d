"""Quality rules, HTML, BPE, toxicity and language identification."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, awkward_rows, docs_of, empty, prose
from zonewright.llm import bpe, html, language, quality, toxicity
from zonewright.llm.common import held_out

SF = "/root/testdata/sf0.01"


# quality


def brute_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    inside = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_agree_with_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in quality.query(spark, SF).collect():
        counts = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_repeat_words_in_small_vocabularies():
    r = random.Random(2)
    for n in (0, 4, 5, 6, 30, 400):
        for size in (1, 2, 3, 50):
            words = [str(r.randrange(size)).encode() for _ in range(n)]
            assert quality.repeat_words(words) == brute_counts(" ".join(w.decode() for w in words))[4]


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.fixture(scope="module")
def judge():
    """Verdicts by limits learned from clean texts of all lengths."""
    limits = quality.learn(prose(i, 30 + 400 * (i % 9)) for i in range(1000, 1600))
    return quality.Compression(limits).judge


def junk(kind, size, seed):
    r, clean = random.Random(seed), prose(seed, size).encode()[:size]
    noise = "".join(r.choices(LETTERS, k=size)).encode()
    words = " ".join("".join(r.choices(LETTERS, k=r.randint(3, 9))) for _ in range(size // 4)).encode()[:size]
    again = (b"spam and eggs " * size)[:size]
    half = {"noise": noise, "words": words, "repeated": again}[kind.removeprefix("half ")][: size // 2]
    return {"noise": noise, "words": words, "repeated": again}.get(kind) or (half + clean[len(half) :] if seed % 2 else clean[len(half) :] + half)


@pytest.mark.parametrize("size", [128, 200, 500, 1000, 3000, 4000, 5000, 7900, 30_000, 100_000])
@pytest.mark.parametrize("kind", ["noise", "words", "repeated", "half noise", "half words", "half repeated"])
def test_bands_reject_junk_at_every_length(judge, kind, size):
    n = 40 if size < 9000 else 6
    assert sum(not judge(junk(kind, size, i))[3] for i in range(n)) >= 0.8 * n


@pytest.mark.parametrize("size", [70, 128, 200, 500, 1000, 3000, 4000, 5000, 7900, 30_000, 100_000])
def test_bands_keep_clean_texts_at_every_length(judge, size):
    n = 200 if size < 9000 else 10
    assert sum(judge(prose(i, size // 2).encode()[:size])[3] for i in range(n)) >= 0.99 * n


def test_bands_without_learning_reject_repetition_and_noise():
    judge = quality.Compression().judge
    noise, clean = junk("noise", 9000, 1), prose(1, 2500).encode()
    assert judge(clean)[3] and judge(clean[:600])[3]
    assert not judge(noise)[3] and not judge(b"spam and eggs " * 600)[3]
    assert not judge(prose(2, 1200).encode() + noise * 2)[3]  # chunks tell


def test_chunks_cover_every_byte():
    judge = quality.Compression(chunks=(100,)).judge
    assert [judge(b"x" * n)[1] for n in (0, 99, 100, 101, 200, 250)] == [0, 0, 1, 2, 2, 3]


def test_limits_between_and_beyond_lengths():
    limits = quality.Limits((100, 200), (1.0, 2.0), (3.0, 5.0), 0.5)
    assert limits.at(100) == (1.0, 3.0) and limits.at(200) == (2.0, 5.0) and limits.at(800) == (2.0, 6.0)
    assert 1.0 < limits.at(150)[0] < 2.0 and limits.at(10) == (0.0, 3.0)
    assert quality.learn([]) == quality.Limits()


def test_quality_of_awkward_rows(spark):
    rows = quality.quality(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows()) and not any(r["kept"] for r in rows if r["doc_id"] in (3, 4, 5, 7, 9))
    assert quality.quality(empty(spark)).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (6, 1), (None, 1), (8, None)], "doc_id long, quality int")
    assert quality.fit(awkward(spark), labels).lengths  # ids 1 and 3 teach nothing
    assert quality.fit(empty(spark), labels) == quality.Limits()


def test_quality_of_held_out_documents(spark):
    """Clean ones stay; of the junk that the base rules pass, as much goes as compression can tell."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    rows = [r for r in quality.query(spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    clean, bad = ([r["kept"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(bad) <= 0.6 * len(bad)


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>More</ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>Head &amp; tail</h1><p>First <b>bo</b>ld&nbsp;part<br>goes on<p>Second %s</p><aside>See also</aside><form>Mail <input></form>
<div class="ad">Buy</div><!-- note --></article><div class="comments"><p>Nice!</p></div><footer>&copy; us</footer></body></html>"""


def test_page_without_its_frame():
    text = "paragraph " * 20
    assert html.Page(PAGE % text).extract([]) == f"Head & tail First bold part goes on Second {text.strip()}"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("inner", ["div", "section"])
def test_text_beside_the_largest_container_stays(tag, inner):
    body = prose(3, 300)
    source = f"""<body><div class="nav">Home</div><ul><li><a href="/">More</a></ul><div><{tag}><h1>Title</h1><p class="lead">Lead</p>
<{inner} class="body"><div><p>{body}</p></div></{inner}><p>Close</p></{tag}></div></body>"""
    assert html.Page(source).extract([]) == f"Title Lead {body} Close"


def test_hosts_keep_titles_and_leads(spark):
    page = '<body><div class="menu">Home</div><article><h1>Title %d</h1><p>Lead</p><section>%s</section></article></body>'
    pages = [(i, "https://h.example/", page % (i, prose(i, 200))) for i in range(3)]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"Title {i} Lead {prose(i, 200)}" for i in range(3)}


@pytest.mark.parametrize("source", ["", "<", "<p", "<script>", "</div>", "<!-- x", '<a href="x>y', "<p>a<p>b", "plain &lt;text&gt;", "<" * 500])
def test_broken_pages(source):
    page = html.Page(source)
    assert isinstance(page.extract([]), str)


def test_text_of_broken_pages():
    assert html.Page("<p>a<p>b").extract([]) == "a b"
    assert html.Page("plain &lt;text&gt;").extract([]) == "plain <text>"


def test_hosts_vote(spark):
    long, note = "<p>" + prose(1, 200) + "</p>", "<p>" + prose(2, 150) + "</p>"
    pages = [(i, f"https://h.example/{i}", f'<body><div class="x1">{note if i == 9 else ""}</div><div class="story s{i}">{"<p>stub</p>" if i == 9 else long}</div></body>') for i in range(10)]
    pages += [(20, None, None), (21, "http://other.example", ""), (9, "https://h.example/9", pages[9][2])]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = [(r["page_id"], r["text"]) for r in rows]
    assert len(got) == len(pages) and got.count((9, "stub")) == 2 and (20, "") in got and (21, "") in got
    assert (0, prose(1, 200)) in got
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def extracted(spark, pages):
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in rows}


@pytest.mark.parametrize(
    "side",
    ['<div id="sidebar"><p>Side %d</p></div>', '<div role="complementary"><p>Side %d</p></div>', '<div style="display: none"><p>Side %d</p></div>',
     '<div hidden><p>Side %d</p></div>', '<div aria-hidden=true><p>Side %d</p></div>', '<div class="page-footer"><div><p>Side %d</p></div></div>',
     '<footer><div><p>Side %d</p></div></footer>', '<div class="comments-list"><div><p>Side %d</p></div></div>'],
)
def test_boilerplate_beside_the_winning_path_stays_out(spark, side):
    pages = [(i, "https://h.example/", f'<body><div><p>{prose(i, 60)}</p><div class="ads"><p>Buy</p></div></div>{side % i}</body>') for i in range(6)]
    assert extracted(spark, pages) == {i: prose(i, 60) for i in range(6)}


def test_parts_with_other_ids_are_not_on_the_path(spark):
    page = '<body><div id="links%d"><p>%s</p></div><div id="content%d"><p>%s</p></div></body>'
    pages = [(i, "https://h.example/", page % (i, "" if i else prose(99, 20), i, prose(i, 60))) for i in range(6)]
    assert extracted(spark, pages) == {i: prose(i, 60) for i in range(6)}


def test_every_template_of_a_host_keeps_its_path(spark):
    """Seven templates without article tags; in each, one page has a long notice of a path of its own."""
    pages, texts = [], {}
    for t in range(7):
        for k in range(4):
            i, texts[10 * t + k] = 10 * t + k, prose(10 * t + k, 40)
            note = f"<section>{prose(500 + t, 60)}</section>" if k == 3 else ""
            pages.append((i, "https://h.example/", f'<body>{note}<div class="t{"abcdefg"[t]}"><p>{texts[i]}</p></div></body>'))
    assert extracted(spark, pages) == texts


def test_a_path_needs_two_votes_and_its_share(spark):
    cast = [("h", "a", 9)] * 60 + [("h", "b", 9)] * 2 + [("h", "c", 50)] + [("k", "a", 9), ("k", "b", 8), ("k", "b", 8)]
    won = html.winners(spark.createDataFrame(cast, "_host string, _path string, _size long")).collect()
    assert {r["_host"]: r["_paths"] for r in won} == {"h": ["a", "b"], "k": ["b"]}


def test_inner_paths_and_several_articles(spark):
    plain = [(i, "https://h.example/", f"<body><p>{prose(i, 50)}</p></body>") for i in range(6)]
    inner = [(i, "https://h.example/", f"<body><p>Ours</p><article><p>{prose(i, 50)}</p></article></body>") for i in range(6, 9)]
    quoting = [(9, "https://h.example/", f"<body><p>{prose(9, 50)}</p><article><p>Quote</p></article></body>")]
    posts = [(10, "https://h.example/", "<body><main><article>One</article><article>Two</article></main></body>")]
    assert extracted(spark, plain + inner + quoting + posts) == {i: prose(i, 50) for i in range(9)} | {9: prose(9, 50) + " Quote", 10: "One Two"}


@pytest.mark.parametrize("part", ["<div>", "<a ", "<b>", "<script ", "<a b=", "<a b='>", '<a href="x ', "<!", "</", "<b></i>", "<p>x"])
def test_time_grows_with_the_page(part):
    import time

    times = []
    for n in (4_000, 16_000):
        start = time.perf_counter()
        page = html.Page(part * n + ">")
        page.extract([page.path(page.container()[0])])
        times.append(time.perf_counter() - start)
    assert times[1] < 0.3 + 8 * times[0]


def test_host_names(spark):
    urls = ["https://User@WWW.Example.com:80/x?y", "//a.b/c", "nothing", None, "ftp://z"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(html.host("u")).collect()
    assert [r[0] for r in rows] == ["www.example.com", "a.b", "", "", "z"]


def test_main_text_of_all_pages(spark):
    rows = html.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert not any("track(" in r["text"] or "©" in r["text"] for r in rows)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# BPE

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(PATH)
    reference.no_truncation()
    reference.no_padding()
    return bpe.Tokenizer.load(PATH), reference


def agree(pair, text):
    own, reference = pair
    ids = own.encode(text)
    expected = reference.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected, text[:80]
    assert own.decode(ids) == reference.decode(expected, skip_special_tokens=False)


def test_bpe_agrees_on_documents(spark, pair):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect():
        agree(pair, r["text"])


def test_bpe_agrees_on_odd_texts(pair):
    r = random.Random(11)
    pool = [*"abcdeinth ABC0129 \n\t'.,!?#-_", "é", "É", "ß", "Σ", "ς", "İ", "ﬁ", "é", " ", "　", "\x1c", "\x85", "​", "中文", "😀", "²", "Ⅷ", "\x00", "'s", "'ll", "<|endoftext|>", "<|startoftext|>"]
    for _ in range(1500):
        agree(pair, "".join(r.choices(pool, k=r.randint(0, 40))))


def test_bpe_streams_long_words(pair):
    r = random.Random(12)
    for k in range(30):
        agree(pair, "".join(r.choices("abcdeinthaonst" if k % 2 else "ab", k=r.randint(33, 1200))))
    for text in ("a" * 4000, "haha" * 900, "!" * 3000, "é" * 500):
        agree(pair, text)


def test_bpe_buffer_is_bounded(pair):
    encoder = bpe.WordEncoder(pair[0].merges)
    most = n = 0
    for i in range(3000):
        n += len(encoder.feed("ab"[i % 2]))
        most = max(most, len(encoder.text))
    assert most <= 3 * pair[0].merges.lookahead and n > 500


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_transducer_agrees_with_plain_merging(pair, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    own, r = pair[0], random.Random(piece)
    for k in range(400):
        word = "".join(r.choices("etaoinshrdlu" if k % 2 else "abn", k=r.randint(1, 12 if k % 4 else 200)))
        symbols = [*word[:-1], word[-1] + own.merges.suffix]
        assert [own.merges.text_of[i] for i in own.word(word)] == own.merges.merge(symbols)


def test_bpe_streams_texts_in_segments(pair, monkeypatch):
    own, text = pair[0], prose(5, 3000) + "\n<|endoftext|> Été\u0301 naïve\t" + "x" * 700 + " " + prose(6, 50)
    whole = own.encode(text)
    monkeypatch.setattr(bpe.segments, "__defaults__", (100,))
    parts = [*own.stream(text)]
    assert len(parts) > 50 and (np.concatenate(parts) == whole).all()
    decoder = own.decoder()
    assert "".join(map(decoder.feed, parts)) == own.decode(whole) == pair[1].decode(whole.tolist(), skip_special_tokens=False)
    assert "".join(bpe.segments(text)) == text


def test_readable_decoding(pair):
    own = pair[0]
    assert own.decode_text(own.encode("Grüße, naïve 😀 world")) == "grüße , naïve 😀 world"


def test_tokens_of_awkward_rows(spark, pair):
    rows = bpe.tokenize(awkward(spark), PATH).collect()
    assert len(rows) == len(awkward_rows()) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert bpe.tokenize(empty(spark), PATH).count() == 0


# toxicity and language


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["score"] for r in rows if labels[r["doc_id"]]]
    clean = [r["score"] for r in rows if not labels[r["doc_id"]]]
    better = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert better > 0.85
    assert sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, None), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


@pytest.mark.parametrize("long", [2000, 8000])  # words; texts that fit once, and texts that never do
def test_a_long_text_does_not_use_up_the_sample(spark, long):
    texts = [prose(i, 30) + (" idiot scum" if i % 3 == 0 else "") for i in range(60)] + [prose(i, long) for i in range(60, 90)]
    labels = spark.createDataFrame([(i, 0, int(i < 60 and i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, max_bytes=32_000)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, texts[:60]), model).collect()}
    assert min(scores[i] for i in range(0, 60, 3)) > max(scores[i] for i in range(1, 60, 3))


def test_toxicity_does_not_depend_on_the_block():
    import pyarrow as pa

    texts = [prose(i, 30) + (" idiot scum" if i % 3 == 0 else "") for i in range(60)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(60)])
    together = model.scores(pa.array(texts))
    assert all(abs(model.scores(pa.array([t]))[0] - together[i]) < 1e-9 for i, t in enumerate(texts))
    assert (together[::3] > 0.5).all() and (together[1::3] < 0.5).all()


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in language.query(spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(awkward_rows())
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert model.predict("12 34 !?") == ("und", 0.0)
    assert model.predict("\u0301 12 \u0308\u0301") == ("und", 0.0)  # marks without a letter
    assert language.identify(docs_of(spark, ["word"]), language.fit(empty(spark))).first()["lang_pred"] == "und"


def brute_prediction(rows, text):
    """The same model over plain dictionaries, a word at a time."""
    words, langs = {}, sorted({x for _, x in rows})
    for t, x in rows:
        words.setdefault(x, Counter()).update(language.words_of(t))
    tables = []
    for size in (None, *language.SIZES):
        counts = {x: Counter() for x in langs}
        for x in langs:
            for w, n in words[x].items():
                for e in [w] if size is None else [f" {w} "[i : i + size] for i in range(len(w) + 3 - size)]:
                    counts[x][e] += n
        kept = {e for c in counts.values() for e, n in c.items() if n >= 2}
        logs = {x: (lambda e, x=x, c=counts, k=len(kept): math.log((c[x][e] + 0.5) / (sum(c[x].values()) + 0.5 * (k + 1)))) for x in langs}
        tables.append((size, kept, logs))
    total = dict.fromkeys(langs, 0.0)
    found = language.words_of(text)
    for w in found:
        if w in tables[0][1]:
            for x in langs:
                total[x] += tables[0][2][x](w)
            continue
        padded, at, n, own = f" {w} ", 0, 0, dict.fromkeys(langs, 0.0)
        while at < len(padded):
            for back, (size, kept, logs) in enumerate(tables[1:]):
                e = padded[at : at + size]
                if len(e) == size and e in kept:
                    for x in langs:
                        own[x] += language.BACKOFF**back * logs[x](e)
                    at, n = at + size, n + 1
                    break
            else:
                at += 1
        for x in langs:
            total[x] += language.UNSEEN * own[x] / max(1, n)
    best = max(langs, key=lambda x: total[x])
    damp = min(len(found), 20) / max(1, len(found))
    return (best, 1 / sum(math.exp(max(-60, (total[x] - total[best]) * damp)) for x in langs)) if found else ("und", 0.0)


def test_language_agrees_with_brute_force(monkeypatch):
    rows = [("the cat sat on the mat, the cat and the hat", "en"), ("der Hund lief durch das Haus und das Haus der Hunde", "de"), ("le chat et le chien dans la maison de la maison", "fr")]
    model = language.train(rows)
    monkeypatch.setattr(language, "BLOCK", 6)
    texts = ["the cat", "das katzenhaus", "maisonette", "xyz 12", "", None, "chat der the lamaison thehund zzz", "12"]
    for text, (lang, score) in zip(texts, model.predictions(texts)):
        expected = brute_prediction(rows, text)
        assert lang == expected[0] and score == pytest.approx(expected[1])


def test_unseen_words_back_off():
    model = language.train([("the cat sat on the mat " * 5, "en"), ("der hund lief durch das haus " * 5, "de")])
    assert model.predict("thecat")[0] == "en" and model.predict("durchlief")[0] == "de"
    assert model.predict("zzzz the")[0] == "en"


def test_long_words_are_read_to_their_end():
    model = language.train([("the cat sat on the mat " * 5, "en"), ("der hund lief durch das haus " * 5, "de")])
    assert model.predict("thecat" * 11 + "durchlief" * 200)[0] == "de"
    assert model.predict("durchlief" * 8 + "thecat" * 200)[0] == "en"


def test_quality_learns_from_all_good_texts(spark):
    texts = [prose(i, 20 + i % 30) for i in range(5300)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(r["doc_id"], 1) for r in docs.select("doc_id").collect()], "doc_id long, quality int")
    own = [r["text"] for r in docs.filter(~held_out("doc_id")).collect()]
    found, whole = quality.fit(docs, labels), quality.learn(own)
    assert found.lengths == whole.lengths and len(own) > 4000
    assert np.allclose(found.least, whole.least) and np.allclose(found.most, whole.most)
    # one text's many chunks all count: none is left out as there are more than four
    long = [" ".join(prose(i, 2000) for i in range(3))]
    assert quality.learn(long).lengths
