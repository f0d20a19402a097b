"""The ten operators on small fixtures, against brute force where SQL cannot say it."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcast.llm import _words, components, decontaminate, htmltext, licences, neardup, packing, quality, secrets, substring, urlfilter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, class_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choices("an er in th es la".split(), k=rng.randint(1, 3))) + rng.choice(("", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice((3, 30, 80, 200))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.01 else "edit" for w in t.split(" ")) for t in base[:15] for _ in range(3)]
    passage = prose(rng, 60)
    shared = [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(6)]
    odd = ["", "   ", "\t\n", "word", "a b", "é ü   x", "x " * 500, "Der " * 100, "z" * 50_000, passage, passage]
    return base + base[:10] + near + shared + odd + [None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s0", len(t or ""), "clash", "clash") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s0", 1, "clash", "clash"), (None, "no id at all", "en", "s0", 1, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ---- words -------------------------------------------------------------------------------------------------
def test_words_equal_the_pattern(texts):
    w = _words.Words(pa.array(texts))
    raw = w.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    by_word = collections.defaultdict(set)
    for x, h in zip(got, w.hashes().tolist(), strict=True):
        by_word[x].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)


# ---- 1 -----------------------------------------------------------------------------------------------------
def brute_substrings(rows, window):
    seen, out = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone.update(range(p, p + window))
            seen.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("window", "base"), [(20, 10), (20, 5), (24, 3), (7, 7)])
def test_substrings(docs, window, base):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(docs, window=window, base=base, block_bytes=20_000).collect())
    assert got == brute_substrings(rows_of(docs), window)


def test_substrings_without_repeats_and_with_odd_words(spark):
    rng = random.Random(2)
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{morse} {rest}"), (2, f"{morse.translate(str.maketrans('ab', 'ba'))} {rest}")]
    rows += [(None, prose(rng, 300)) for _ in range(5)] + [(9, " ".join(f"x{rng.random()}" for _ in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(df, bucket_bytes=50_000).collect())
    assert got == brute_substrings(rows, 20) and all(k[2] == 0 for k in got if k[0] in (1, 2, 9))


def test_substrings_of_nothing(empty):
    assert substring.dedup_substrings(empty).count() == 0


# ---- 2 -----------------------------------------------------------------------------------------------------
PAGE = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-banner">We use cookies.</div>'
        '<article><h1>Big   news</h1><p><b>First &amp; best,\n said they.<br><p>Second&nbsp;paragraph, a longer one with many words in it.</p></article>'
        '<section class="comments"><p>Nice post, thank you!</p></section><footer>&copy; me</footer></body></html>')


def test_main_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (1, "u", PAGE, 1), (4, "u", PAGE[: PAGE.index("Second") + 12], 1), (None, "u", "<p", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.main_text(df).collect()]
    whole = "Big news\n\nFirst & best, said they.\n\nSecond paragraph, a longer one with many words in it."
    assert got[0] == (1, whole, len(whole)) and got[3] == got[0] and got[1] == (2, "", 0) and got[2] == (3, "", 0) and got[5] == (None, "", 0)
    assert got[4][1].startswith("Big news\n\nFirst & best, said they.\n\nSecond")
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_crf_on_held_out_layouts():
    model = htmltext.default_model()
    held = htmltext.sequences(htmltext.labelled_pages(150, 99))
    hits = [a == b for feats, y in held for a, b in zip(model.viterbi(feats), y, strict=True)]
    assert sum(hits) / len(hits) > 0.98


MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul>'


@pytest.mark.parametrize(("page", "text"), [  # written by hand, not by the maker of labelled pages
    (f"<body>{MENU}<article><h1>Sales of the year</h1><p>The table below lists the sales of each year so far.</p><table><tr><th>Year</th><th>Sales</th></tr><tr><td>2001</td><td>55</td></tr></table></article></body>",
     ["Sales of the year", "The table below lists the sales of each year so far.", "Year", "Sales", "2001", "55"]),
    ("<html><body><p>This is the first of two paragraphs on a page without any other markup.</p><p>And this is the second one, which says a little more.</p></body></html>",
     ["This is the first of two paragraphs on a page without any other markup.", "And this is the second one, which says a little more."]),
    (f"<body>{MENU}<table width=600><tr><td><b>An old page</b><br><p>In those days pages were laid out with tables, and nobody minded.</p><p>Some of them are still around.</p></td></tr></table><div class=footer>&copy; 1999 us</div></body>",
     ["An old page", "In those days pages were laid out with tables, and nobody minded.", "Some of them are still around."]),
    ('<body><div id="content"><div class="hatnote">For other uses, see <a href="/x">Mercury</a>.</div><p>Mercury is the first planet from the Sun, and the smallest one.</p></div></body>',
     ["Mercury is the first planet from the Sun, and the smallest one."]),
])
def test_pages_of_other_makers(page, text):
    assert htmltext.extract(page, htmltext.default_model()).split("\n\n") == text


def test_deep_and_long_pages_take_linear_time():
    times = []
    for n in (5_000, 40_000):
        began = time.time()
        blocks = htmltext.blocks_of("".join(f'<div class="c{k % 7}"><li>x' for k in range(n)) + "</p>" * n)
        assert len(blocks) == n
        htmltext.describe(blocks)
        times.append(time.time() - began)
    assert times[1] < 20 * max(times[0], 0.05)


def test_invented_tags_take_linear_time_and_memory():
    import tracemalloc

    page = "".join(f"<x{k}><div>word {k}" for k in range(11_000))
    assert len(page) > 200_000
    model = htmltext.default_model()
    tracemalloc.start()
    began = time.time()
    htmltext.extract(page, model)
    took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 20 and most < 200e6


def test_tags_without_weights_change_no_label():
    model = htmltext.default_model()
    for page, _ in htmltext.labelled_pages(40, 5):
        assert model.viterbi(htmltext.describe(htmltext.blocks_of(page))) == model.viterbi(htmltext.describe(htmltext.blocks_of(page, model.tags)))


def test_viterbi_is_the_best_path():
    model = htmltext.Crf({"a": (0.3, 0.9), "b": (1.0, -0.2)}, [[0.5, -1.0], [-0.3, 0.8]], [0.1, 0.0])
    feats = [["a"], ["b"], ["a", "b"], ["a"], []]

    def score(path):
        s = model.start[path[0]] + sum(model.move[x][y] for x, y in zip(path, path[1:], strict=False))
        return s + sum(model.state[f][y] for fs, y in zip(feats, path, strict=True) for f in fs)

    every = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
    assert score(model.viterbi(feats)) == max(map(score, every))


# ---- 3 -----------------------------------------------------------------------------------------------------
def test_secrets(spark):
    token = base64.b64encode(hashlib.sha512(b"k").digest()).decode()
    rows = [
        (1, 'token = "abcdef123456" and Password:\'hunter2secret\' é', 1), (2, "AKIA" + "Q" * 16 + " AKIAQQ", 1), (3, "0123456789abcdef01234567 0123", 1), (4, None, 1), (5, "secret:token:abcdefgh apikey=12345", 1),
        (6, "plain words only, nothing to see here", 1), (7, f"é key {token[:60]} end", 1), (1, "ſecret = abcdefgh", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base int")
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.base], [(s.kind, s.start, s.end) for s in r.found]) for r in secrets.find_secrets(df.coalesce(1)).collect()]
    assert got[0][1] == [("assign", 0, 21), ("assign", 27, 50)] and got[1][1] == [("access", 0, 20)] and got[2][1] == [("hex", 0, 24)]
    assert got[3][1] == [] and got[4][1] == [] and got[5][2] == [] and got[7][1] == []
    assert got[6][2] == [("random", 6, 66)]
    assert secrets.redact("a token = abcdefgh b", [(2, 18, "assign")]) == "a [assign] b"
    assert secrets.find_secrets(df.limit(0)).count() == 0


def brute_spans(text):
    """The three patterns by a walk over every place, without the operator's patterns."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    run = lambda at, letters: next((k for k in range(at, len(text)) if text[k] not in letters), len(text))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out, at = [], 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = None
        if word:
            k = at + len(word)
            k += k < len(text) and text[k] in "\"'"
            k = run(k, " ")
            if k < len(text) and text[k] in ":=":
                k = run(k + 1, " ")
                k += k < len(text) and text[k] in "\"'"
                end = run(k, digits + upper + lower + "+/_.=-")
                if end > k:
                    if end - k >= 6:
                        out.append((at, end, "assign"))
                else:
                    end = None
        at = end or at + 1
    for kind, lead, letters, least in (("access", "AKIA", upper + digits, 20), ("hex", "", digits + "abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(at + len(lead), letters) if text.startswith(lead, at) else at
            if end > at + len(lead):
                if end - at >= least:
                    out.append((at, end, kind))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def test_base_spans_equal_brute_force():
    rng = random.Random(31)
    bits = ["password", "Token", "api_key", "APIKEY", "apikey", "secret", "passwd", " ", "  ", ":", "=", "\"", "'", "abcdef", "AKIA", "0123456789abcdef", "QWERTYUIOP12", "é", ".", "x", "-", "\n", "ſ", "K"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        assert secrets.base_spans(text) == brute_spans(text), text


def test_battery_tells_random_from_ordinary():
    rng = random.Random(3)
    ordinary = ["internationalization_of_everything", "aaaaaaaaaaaaaaaaaaaaaaaa", "2024-05-14-2024-05-14-2024", "com_example_package_ClassName_method", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    assert all(secrets.p_ordinary(t) > 1e-3 for t in ordinary)
    alphabets = dict(secrets.ENCODINGS)
    for name, least in (("hex-upper", 20), ("alnum", 24), ("base64", 24), ("base64-url", 32), ("base32", 64), ("base36", 64), ("letters", 64)):
        for n in (n for n in (20, 24, 32, 64, 500, 2000, 5000) if n >= least):
            hits = [secrets.p_ordinary("".join(rng.choices(alphabets[name], k=n)) + "=" * (name == "base64")) < 1e-2 for _ in range(60)]
            assert np.mean(hits) > 0.85, (name, n)
    made = [secrets.p_ordinary(secrets._ordinary(rng, name, n)) < 1e-3 for name in list(alphabets)[1:] for n in (20, 40, 100, 1000) for _ in range(20)]
    assert np.mean(made) < 0.02


def test_many_spans_take_linear_time():
    token = base64.b64encode(hashlib.sha512(b"k").digest()).decode()[:40]
    text = "".join(f"token=abcdef{i} {token} " for i in range(8000))
    began = time.time()
    spans = secrets.base_spans(text)
    assert len(spans) == 8000 and len(secrets.candidates(text, spans)) == 8000 and time.time() - began < 20


# ---- 4 -----------------------------------------------------------------------------------------------------
def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        x = split(t)
        n = min(window, len(x))
        for p in range(len(x) - n + 1) if n else ():
            for q in range(len(w) - n + 1):
                if w[q : q + n] == x[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_bytes", [6 << 20, 1200])
def test_decontamination(spark, max_bytes):
    rng = random.Random(1)
    items = [(10, prose(rng, 25)), (2, prose(rng, 4)), (3, "..."), (4, None), (5, "été à PARIS"), (9, "q w e r t y u i o p")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    leak = items[0][1].split(" ")
    rows = [(1, prose(rng, 20) + " -- " + " ".join(leak[5:18]).upper() + "! tail"), (2, None), (3, ""), (4, "été;à paris and " + items[1][1]), (5, "nothing here"), (6, "Q-W-E-R-T-Y-U-I-O-P q w e r t y u i o p"), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.decontaminate(df, bench, max_bytes=max_bytes).collect()
    got.sort(key=lambda r: [t for _, t in rows].index("x") if r.n_words == 1 else r.doc_id - 1)
    assert [tuple(r)[1:6] for r in got] == [brute_hits(t, items) for _, t in rows]
    assert all(rows[3][1][s.start : s.end].lower() for s in got[3].spans) and rows[3][1][got[3].spans[0].start : got[3].spans[0].end] == "été;à paris"
    assert sorted(r.doc_id for r in decontaminate.keep_clean(df, bench, max_bytes=max_bytes).collect()) == [1, 2, 3, 5]
    assert not decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count() and not decontaminate.decontaminate(df.limit(0), bench).count()


def test_items_without_an_id_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(None, item, 1), (None, "only four words here", 1), (7, item, 1)], "item_id string, text string, doc_id int")
    long = " ".join(f"w{i}" for i in range(100_000)) + " " + item
    df = spark.createDataFrame([(1, item, 5), (2, "say only four words here", 5), (3, long, 5), (4, "clean", 5)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {1: (11, 2, ["7"], True), 2: (4, 1, [], True), 3: (11, 2, ["7"], True), 4: (0, 0, [], False)}
    assert [r.doc_id for r in decontaminate.keep_clean(df, bench).collect()] == [4]


# ---- 5 -----------------------------------------------------------------------------------------------------
def public_vocabulary():
    import public_tokenizers as p

    return Path(p.path("byte_bpe_50k.json")).read_bytes(), Path(p.path("byte_bpe_50k.tiktoken")).read_bytes(), p.PATTERN, (("<|endoftext|>", 50256),)


def pieces_are_whole(rows, pieces):
    """Every document is tiled by pieces with the right checksums, and sequences are gapless and full or a power of two."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(public_vocabulary()[0].decode())
    want, starts = collections.Counter(), collections.Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, ids.tobytes())] += 1
        starts[(i, len(ids), 0)] += 1
    # walk every document from its start: pieces of repeated rows are told apart by their checksums alone
    left = collections.Counter((p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32) for p in pieces)
    for (i, raw), n in want.items():
        ids = np.frombuffer(raw, "<u4")
        at = [0] * n
        for key in sorted(k for k in left if k[0] == i and k[1] == len(ids)):
            crc = zlib.crc32(ids[key[2] : key[2] + key[3]].tobytes())
            while crc == key[4] and left[key] and key[2] in at:
                at[at.index(key[2])] += key[3]
                left[key] -= 1
        assert at == [len(ids)] * n
    assert not +left
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0


def test_packing(docs, empty, spark):
    pieces_are_whole(rows_of(docs), packing.public_pack(docs).collect())
    assert packing.public_pack(empty).count() == 0
    odd = spark.createDataFrame([(None, ""), (None, None), (1, ""), (1, ""), (2, " " * 1_000_000)], "doc_id bigint, text string")
    pieces_are_whole(rows_of(odd), packing.public_pack(odd).collect())


def test_both_encoders_agree():
    vocabulary, *fast = public_vocabulary()
    slow, fast = packing.encoder(vocabulary), packing.encoder(vocabulary, *fast)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4FFF), 0x1F600, 10, 32, 0xA0))) for _ in range(60)) + rng.choice(("", "<|endoftext|>"))
        assert slow(text).tolist() == fast(text).tolist()


def test_neighbours_equal_brute_force():
    assert packing.Index([np.array(x, np.uint32) for x in ([1, 2, 3, 4], [1, 2, 3, 9], [7, 8], [1, 6])]).neighbours(0).tolist() == [1, 3]
    rng = random.Random(6)
    docs = [np.append(rng.choices(range(2, 300), k=rng.randint(5, 60)), 1).astype(np.uint32) for _ in range(80)]
    df, n, mean = collections.Counter(t for d in docs for t in set(d.tolist())), len(docs), np.mean([len(d) for d in docs])
    index = packing.Index(docs)
    for i, seed in enumerate(docs):
        want = [sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(seed.tolist()) if (c := (d == t).sum())) for d in docs]
        assert np.allclose(index.scores(i), want, rtol=1e-4)


def test_best_neighbours_are_packed_together(spark):
    import public_tokenizers as p

    rng = random.Random(9)
    topics = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12)] for _ in range(60)]
    rows = [(k + 60 * c, " ".join(rng.choices(topics[k], k=60)), 1) for k in range(60) for c in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, x int").repartition(3)
    got = packing.pack(df, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, (("<|endoftext|>", 50256),), shard_bytes=40_000).collect()
    pieces_are_whole([r[:2] for r in rows], got)
    place = collections.defaultdict(set)
    for r in got:
        place[r.doc_id].add(r.sequence_id)
    with_kin = sum(any(place[i] & place[(i + 60 * c) % 240] for c in (1, 2, 3)) for i in range(240))
    assert len({s >> 40 for s in set().union(*place.values())}) > 1 and with_kin > 0.9 * 240


# ---- 6 -----------------------------------------------------------------------------------------------------
def test_url_rules_and_reputation(spark):
    urls = ["http://a.net", "http://a.net/", "https://example.net/en/x?q#f", "http://www.Example.COM/de/", "http://x.org/fr/1", "http://x.org:80/fr/1", "nothing", None, "ftp://bad.example/p", "http://notnet/", "HTTP://u@h.net/en?x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id bigint, url string, rule string")
    outcomes = spark.createDataFrame([("http://bad.example/", 0)] * 60 + [("http://good.example/", 1)] * 60, "url string, good bigint")
    got = sorted([tuple(r)[:5] for r in urlfilter.filter_urls(df, outcomes).collect()])
    assert got[0] == got[1] and len(got) == 12
    by = {r[0]: r[1:] for r in got}
    assert by[0] == ("a.net", "", None, "allow") and by[1][2:] == ("net/", "block") and by[2] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by[3] == ("www.example.com", "/de/", "example.com/de/", "block") and by[4][2] == "org/fr/" and by[5] == ("x.org:80", "/fr/1", None, "allow")
    assert by[6] == by[7] == ("", "", None, "allow") and by[8][3] == "block" and by[9][2] is None and by[10] == ("u@h.net", "/en", "net/", "block")
    assert urlfilter.filter_urls(df.limit(0), outcomes).count() == 0


def test_little_evidence_stays_near_the_prior(spark):
    rows = [(f"http://h{i}.example/", 1) for i in range(50) for _ in range(10)] + [("http://one.example/", 0)]
    level = urlfilter.reputations(urlfilter.host_counts(spark.createDataFrame(rows, "url string, good bigint")))
    rep = {r.host: r for r in level["host"].collect()}
    assert rep["one.example"].upper > 0.5 and rep["h1.example"].mean > 0.9


def test_hosts_without_outcomes_fall_back(spark):
    outcomes = spark.createDataFrame([(f"http://h{i}.bad.example/", 0) for i in range(6) for _ in range(100)] + [(f"http://h{i}.good{i}.test/", 1) for i in range(30) for _ in range(20)], "url string, good bigint")
    pages = spark.createDataFrame([(1, "http://new.bad.example/x"), (2, "http://new.good1.test/"), (3, "http://other.test/"), (4, "http://h1.bad.example/"), (5, "http://what.else/"), (6, "http://bad.example:8080/")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, outcomes).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block"}
    none = urlfilter.filter_urls(pages, outcomes.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"}


# ---- 7 -----------------------------------------------------------------------------------------------------
def brute_classes(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if sets[a] and (both >= t * sum((sets[a] | sets[b]).values()) - 1e-9 or (rows[a][0] == rows[b][0] and rows[a][0] is not None)):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(docs, empty):
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == brute_classes(rows_of(docs))
    assert neardup.near_duplicates(empty).count() == 0


def test_one_of_each_class_stays(docs):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, c in brute_classes(rows_of(docs)) if c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and None in ids


def test_an_id_with_several_texts(spark):
    rng = random.Random(21)
    a, b = prose(rng, 60), prose(rng, 60)
    longer = lambda t: t + " more"
    for rows, kept in (
        ([(1, a), (3, a), (3, b), (4, b)], [(1, a), (3, b)]),
        ([(3, a), (3, b), (4, longer(b)), (5, longer(a))], [(3, a), (3, b)]),
        ([(None, a), (7, longer(a)), (None, b), (None, b), (2, ""), (7, " ")], [(2, ""), (7, " "), (7, longer(a)), (None, b)]),
    ):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        assert sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()), key=repr) == brute_classes(rows)
        assert sorted(map(tuple, neardup.keep_one(df).collect()), key=repr) == sorted(kept, key=repr)


def test_words_that_fool_polynomials_differ():
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    h = [_words.Words(pa.array([morse, morse.translate(str.maketrans("ab", "ba"))])).hashes(s) for s in (0, 1)]
    assert h[0][0] != h[0][1] and h[1][0] != h[1][1]


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(4)
    a = {i: rng.randint(1, 9) for i in range(60)}
    b = {i: max(1, w + rng.randint(-3, 3)) for i, w in list(a.items())[10:]} | {100 + i: 2 for i in range(10)}
    keys = _words.mix(np.arange(200, dtype=np.uint64))
    cat = [np.array(x) for x in zip(*[(r, k, w) for r, s in enumerate((a, b)) for k, w in s.items()], strict=True)]
    sig = neardup.signatures(cat[0], keys[cat[1]], cat[2], 2, 4096)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(130, 129), (500, 400), (7, 7)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.comp for r in components.components(df).collect()}
    assert got == {r.node: r.comp for r in components.components(df, per=20).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 131)} == {100} and got[500] == got[400] == 400


# ---- 8 -----------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y %0A", "same"), (2, None, "same"), (3, "http://c", "é" * 1000), (4, "u", None), (5, "u", ""), (None, "u", "same"), (3, "http://c", "é" * 1000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    index = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=500)
    assert index.count() == 7 and index.where("length > 0").count() == 7
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_archives(index, f"file://{tmp_path}/w", most=700).collect()), key=repr)
    want = sorted([(1, rows[0][1], "revisit", 2, 4, None), (2, None, "response", None, 4, "same"), (3, "http://c", "response", None, 2000, "é" * 1000), (4, "u", "revisit", 5, 0, None),
                   (5, "u", "response", None, 0, ""), (None, "u", "revisit", 2, 4, None), (3, "http://c", "response", None, 2000, "é" * 1000)], key=repr)
    assert got == want
    raw = b"".join(zlib.decompress(p.read_bytes()[r.offset : r.offset + r.length], 31) for p in (tmp_path / "w/records").iterdir() for r in index.where("page_id < 3").collect() if r.file == p.name)
    assert b"WARC-Target-URI: http://a/%0D%0AX: y %0A\r\n" in raw and b"WARC-Refers-To-Date" in raw
    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(zlib.decompress(p.read_bytes()[r.offset : r.offset + r.length], 31) for p in (tmp_path / "w/records").iterdir() for r in index.collect() if r.file == p.name))
    assert len(ids) == len(set(ids)) == 7
    one = warc.read_archives(index.where("page_id = 3").limit(1), f"file://{tmp_path}/w").collect()
    assert one[0].payload_digest == base64.b32encode(hashlib.sha1(("é" * 1000).encode()).digest()).decode()
    small = warc.write_archives(df, f"file://{tmp_path}/m", min_bytes=1000)
    assert {r.record_type for r in warc.read_archives(small, f"file://{tmp_path}/m").collect()} == {"response"}
    none = warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(none, f"file://{tmp_path}/e").count() == 0


def test_damage_is_noticed():
    raw, _ = warc.record("<urn:x>", 1, "u", b"payload", None, None, False, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload", b"pAyload"))


# ---- 9 -----------------------------------------------------------------------------------------------------
def test_licences(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) + "\n" + prose(rng, 8)) for i in range(40)]
    rows += [(100, "Intro.\nReleased under the MIT License."), (101, "Licensed under the Apache License, Version 2.0."), (102, "This work is licensed under the GNU General Public License, version 3."),
             (103, "text\nLicensed under CC BY-NC 4.0."), (104, None), (105, ""), (106, "All rights reserved."), (100, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("licences", F.lit(1))
    model = licences.fit(df)
    assert model["held_out_unknown"] > 0.97 and model["held_out_family"] > 0.95
    got = [(r.doc_id, sorted({x.family for x in r.licences if x.confirmed})) for r in licences.scan(df, model).collect()]
    want = {100: ["MIT"], 101: ["Apache-2.0"], 102: ["GPL-3.0"], 103: ["CC-BY-NC-4.0"], 106: ["All-rights-reserved"]}
    assert got == [(i, want.get(i, [])) for i, _ in rows]
    assert licences.scan(df.limit(0), model).count() == 0


def test_licences_in_long_lines_and_by_their_text(spark):
    rng = random.Random(12)
    mit = licences.TEXTS["MIT"].split(" ")
    rows = [(1, prose(rng, 200) + " Released under the MIT License. " + prose(rng, 200)), (2, " ".join(mit[:40])), (3, prose(rng, 50) + "\n" + licences.TEXTS["BSD-3-Clause"]),
            (4, prose(rng, 400)), (5, prose(rng, 90) + " Licensed under CC BY-NC 4.0. " + prose(rng, 90) + " " + " ".join(mit[:30]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: {x.family for x in r.licences if x.confirmed} for r in licences.scan(df, licences.fit(df)).collect()}
    wrapped = licences.TEXTS["MIT"].split(" ")
    odd = [(1, "\n".join(" ".join(wrapped[i : i + 7]) for i in range(0, 70, 7))), (2, "This program is not released under the MIT License."), (3, "It is no longer available under the Apache License 2.0"), (4, "Released under the\nMIT License.\n\nNo more.")]
    found = {r.doc_id: (r.n_paragraphs, {x.family for x in r.licences if x.confirmed}) for r in licences.scan(spark.createDataFrame(odd, "doc_id bigint, text string"), licences.fit(df)).collect()}
    assert found == {1: (1, {"MIT"}), 2: (1, set()), 3: (1, set()), 4: (2, {"MIT"})}
    assert got[1] == {"MIT"} and got[2] == {"MIT"} and "BSD-3-Clause" in got[3] and got[4] == set() and got[5] == {"MIT", "CC-BY-NC-4.0"}


# ---- 10 ----------------------------------------------------------------------------------------------------
def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs, empty):
    got = quality.judge(quality.ledger(docs)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, *[r[c] for c in cols]) for r in got], key=key) == sorted([(i, *brute_quality(t)) for i, t in rows_of(docs)], key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.ledger(empty).count() == 0 and quality.keep_passing(docs).columns == docs.columns


def test_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean), (2, clean + " idiot"), (3, "short"), (4, " ".join(f"w{i}%%%" for i in range(80))), (5, "\n".join(["same line"] * 40))]
    book = quality.ledger(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept = lambda p: sorted(r.doc_id for r in quality.judge(book, p).where("kept").collect())
    assert kept("default-1") == [1, 2] and kept("default-2") == [1] and kept("base-1") == [1, 2, 4]
    a = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(book, "default-1").collect()}
    assert a["symbol_heavy"] == (1, 1, 3) and a["few_words"] == (1, 1, 3) and a["duplicate_lines"][0] == 1


def test_many_tiny_texts_pack_in_linear_time():
    tokens = [np.array([1], np.uint32)] * 120_000
    began = time.time()
    made = packing.plan([1] * len(tokens), packing.Index(tokens), 2048)
    assert time.time() - began < 40 and sum(p[2] for p in made) == len(tokens) and len({p[0] for p in made}) == len(tokens)


def test_ranked_neighbours_equal_the_search_for_each(monkeypatch):
    rng = np.random.default_rng(4)
    tokens = [rng.integers(0, 60, rng.integers(1, 9)).astype(np.uint32) for _ in range(800)]
    plans = []
    for many in (2, 12, 10**9):
        monkeypatch.setattr(packing, "MANY", many)
        plans.append(packing.plan([len(t) for t in tokens], packing.Index(tokens), 128))
    assert plans[0] == plans[1] == plans[2]


def test_terms_of_many_documents_are_not_gathered_by_posting():
    rng = np.random.default_rng(11)
    docs = [np.append(np.minimum(rng.geometric(0.02, rng.integers(5, 120)), 400), 1).astype(np.uint32) for _ in range(300)]
    docs[7] = docs[3]
    index, n, mean = packing.Index(docs), len(docs), np.mean([len(d) for d in docs])
    most = np.diff(index.at).max()
    assert 0 < most <= n / 8, "what a seed gathers term by term is at most an eighth of the documents each"
    assert np.count_nonzero(index.rows) >= index.rows.size / 8, "rows stay in proportion to the postings they stand for"
    tf = np.array([np.bincount(d, minlength=401) for d in docs], float)
    df, length = (tf > 0).sum(axis=0), tf.sum(axis=1)[:, None]
    weight = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    used = np.zeros(n, bool)
    for gone in (0, 100, 150, 290):  # scores stay right as used documents are left out
        used[rng.choice(np.setdiff1d(np.flatnonzero(~used), [3, 7]), gone - used.sum(), replace=False)] = True
        index.drop(used)
        for seed in range(0, n, 10):
            want, got = weight[:, tf[seed] > 0].sum(axis=1), index.scores(seed)
            assert np.allclose(got[~used], want[~used], rtol=1e-4) and got[3] == got[7]
            assert ((got > 0) == (want > 0))[~used].all() and len(index.live) <= max(1.25 * (~used).sum(), 1)
