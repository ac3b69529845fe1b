"""Operators that look at one text at a time, against the libraries or plain code."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomtext.llm import bpe, html_extract, language_id, packing, pii, toxicity
from loomtext.llm.common import held_out, table

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "It's we'll I'M 12345 <|endoftext|> x<|startoftext|>", "İΣσ Σ", "é é Å", "世界 \U0001f600\U0001f468‍\U0001f469", "a b c　d", "tab\tnl\r\n\x0b\x0c end  ",
    "x" * 3000, "ab" * 700 + "!" * 300, "\x00\x01\x7f", "مرحبا नमस्ते", "ﬁ ① ½", "...,,,;;; -- __", "ẞ STRASSE", "  lead and trail  ", "a.b,c;d:e!f?g)",
]


def test_word_bpe_is_the_librarys(documents):
    library, own = Tokenizer.from_file(WORD), bpe.WordBpe(WORD)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    alphabet = "aAbzZ09 .,'éßİΣ世 ́\n\t<|>'s"
    texts = [*ODD, *documents.text[:60], *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400))]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids, t[:80]
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False), t[:80]


def test_long_words_merge_alike():
    own = bpe.WordBpe(WORD)
    rng = random.Random(2)
    for _ in range(60):
        parts = [own.inner[rng.choice(b"aeinrst")] for _ in range(rng.randrange(2, 240))]
        assert own.merge(list(parts)) == own._merge_long(list(parts))


def test_bpe_edges(spark, edges, nothing):
    out = bpe.encode_documents(edges, WORD, with_ids=True).collect()
    assert len(out) == edges.count() and bpe.encode_documents(nothing, WORD).count() == 0
    empty = next(r for r in out if r["doc_id"] == 2)
    assert (empty["n_tokens"], empty["ids_sha256"], empty["ids"]) == (0, hashlib.sha256(b"").hexdigest(), [])
    assert len({r["ids_sha256"] for r in out if r["doc_id"] == 1}) == 1


def test_packing_pieces_are_the_librarys(spark, documents):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(12)
    alphabet = "aAbzZ09 .,'éßİΣ世 ́\n\t<|>'s  \n"
    texts = [*ODD, *documents.text[:80], *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)), "a <|endoftext|> b<|endoftext|>\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = packing.pack_documents(df, BYTE, with_ids=True).toPandas()
    for i, t in enumerate(texts):
        own = rows[rows.doc_id == i].sort_values("start")
        want = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert [x for ids in own.ids for x in ids] == want, t[:80]
        assert list(own.start) == list(np.cumsum([0, *own.length[:-1]])) and set(own.doc_tokens) == {len(want)}
        assert all(c == zlib.crc32(np.array(ids, "<u4").tobytes()) for c, ids in zip(own.ids_crc32, own.ids))
    check_sequences(rows)


def check_sequences(rows):
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum([0, *own.length[:-1]])) and own.length.sum() <= 2048


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(1, 80))), reverse=True)
        room, want = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            if b == len(room):
                room.append(100)
            want.append((b, 100 - room[b]))
            room[b] -= s
        assert packing.first_fit_decreasing(sizes, 100) == want
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([101], 100)


def test_packing_edges(spark, edges, nothing):
    rows = packing.pack_documents(edges, BYTE).toPandas()
    check_sequences(rows)
    assert packing.pack_documents(nothing, BYTE).count() == 0
    assert rows[rows.doc_id == 2].length.tolist() == [1] and len(rows[rows.doc_id == 1]) == 2
    same = edges.where("doc_id = 2").crossJoin(edges.sparkSession.range(20).select()).unionByName(edges.where("doc_id = 2"))
    dealt = packing.pack(packing.pieces(same, BYTE), same.count(), group_pieces=2).toPandas()
    check_sequences(dealt)
    assert len(dealt) == 21 and dealt.sequence_id.nunique() > 3  # equal rows are in many groups
    groups = packing.pack(packing.pieces(edges, BYTE), edges.count(), group_pieces=3).toPandas()
    check_sequences(groups)
    assert groups.length.sum() == rows.length.sum()


def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit_prototypes(docs.where(~held_out("doc_id", 4, 2)), key="doc_id")
    scored = language_id.predict_language(docs.where(held_out("doc_id", 4, 2)), model, ["doc_id", "lang"]).toPandas()
    assert (scored.lang == scored.lang_pred).mean() > 0.97


def test_language_vectors_match_plain_code():
    encoder, text = language_id.Encoder(64), "Ab, cé ab"
    letters = " ab cé ab "
    want = np.zeros(64)
    for i in range(len(letters) - 2):
        v = np.ones(64)
        for place, c in enumerate(reversed(letters[i : i + 3])):
            v = v * np.roll(encoder.letter(ord(c)), place)
        want += v
    got, counts = encoder.bundle([text, "123", ""])
    assert np.array_equal(got[0], want) and list(counts) == [len(letters) - 2, 0, 0]


def test_language_predictions_are_those_of_plain_code(spark, documents):
    some = documents.head(60)
    df = spark.createDataFrame([(int(i), t, l) for i, t, l in zip(some.doc_id, some.text, some.lang)], "doc_id bigint, text string, lang string")
    letter = language_id.Encoder().letter

    def vector(text):
        text = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        out = np.zeros(language_id.DIMENSION)
        for gram, n in Counter(text[i : i + 3] for i in range(len(text) - 2)).items():
            v = np.ones(language_id.DIMENSION)
            for place, c in enumerate(reversed(gram)):
                v *= np.roll(letter(ord(c)), place)
            out += n * v
        return out

    vectors = {i: vector(t) for i, t in zip(some.doc_id, some.text) if any(c.isalpha() for c in t)}
    profiles = {l: sum(vectors[i] for i, x in zip(some.doc_id, some.lang) if x == l and i in vectors) for l in sorted(set(some.lang.dropna()))}
    model = language_id.fit_prototypes(df, key="doc_id")
    assert sorted(model) == sorted(profiles) and all(np.allclose(model[l], v) for l, v in profiles.items())
    for r in language_id.predict_language(df, model, ["doc_id"]).collect():
        if r["doc_id"] not in vectors:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = vectors[r["doc_id"]]
        cosine = {l: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for l, w in profiles.items()}
        assert r["lang_pred"] == max(sorted(cosine), key=cosine.get) and abs(r["score"] - max(0, max(cosine.values()))) < 1e-4


def test_language_edges(spark, edges, nothing):
    model = language_id.fit_prototypes(edges, key="doc_id")
    rows = language_id.predict_language(edges.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert language_id.fit_prototypes(nothing, key="doc_id") == {} and language_id.predict_language(nothing, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(edges, {}, ["doc_id"]).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 3, 1)), toxic=300, other=900)
    judged = docs.join(labels.where(held_out("doc_id", 3, 1)), "doc_id")
    rows = toxicity.score_documents(judged, model, ["toxic"]).toPandas()
    caught = rows[rows.toxic == 1].predicted.mean()
    wrong = rows[rows.toxic == 0].predicted.mean()
    assert caught > 0.85 and wrong < 0.02, (caught, wrong)
    assert ((rows.score >= 0.7).astype(int) == rows.predicted).all()


def test_toxicity_training_is_that_of_plain_code(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    monkeypatch.setattr(toxicity, "_PART", 50)
    rng = random.Random(17)
    texts = [" ".join(rng.choice(["bad", "awful"] if k % 3 == 0 else ["calm", "tea"]) + rng.choice("xyz") for _ in range(6)) for k in range(30)]
    y = np.array([float(k % 3 == 0) for k in range(30)])
    rows = [toxicity.counted(t) for t in texts]
    mass = [Counter(), Counter()]
    for (f, c), label in zip(rows, y):
        for a, n in zip(f.tolist(), c.tolist()):
            mass[int(label)][a] += math.log2(1 + n)
    total = [sum(m.values()) for m in mass]
    share = lambda k, a: mass[k][a] / total[k] + toxicity.SMOOTH / total[1]
    plain = {a: math.log(share(1, a) / share(0, a)) for a in set(mass[0]) | set(mass[1])}
    plain = {a: r for a, r in plain.items() if abs(r) >= toxicity.LEAST_RATIO}
    ratio = toxicity.log_count_ratio(rows, y)
    assert set(np.flatnonzero(ratio)) == set(plain) and all(abs(ratio[a] - r) < 1e-9 for a, r in plain.items())
    # the same descent on a dense table
    used = sorted(plain)
    x = np.array([[math.log2(1 + dict(zip(f.tolist(), c.tolist())).get(a, 0)) * plain[a] for a in used] for f, c in rows])
    scale = 1 / math.sqrt(max(1.0, (x**2).sum(axis=1).mean()))
    x *= scale
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, velocity, b, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for _ in range(150):
        error = balance * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        velocity, vb = 0.9 * velocity - 4.0 * (x.T @ error + 2e-4 * w), 0.9 * vb - error.sum()
        w, b = w + velocity, b + vb
    assert np.allclose(toxicity.fit_weights(rows, y)[used], w * [plain[a] for a in used] * scale, rtol=2e-3, atol=1e-4)
    for _ in range(50):
        margins, labels = np.array([rng.choice(range(8)) + rng.random() for _ in range(12)]), np.array([rng.random() < 0.5 for _ in range(12)], float)
        errors = lambda cut: int(((margins >= cut) != (labels > 0)).sum())
        assert errors(toxicity.best_cut(margins, labels)) == min(errors(c) for c in [-1, *(margins + 1e-9), 99])


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.fit(edges, given)
        rows = toxicity.score_documents(edges.select("doc_id", "text"), model, ["doc_id"]).collect()
        assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(nothing.select("doc_id", "text"), model, ["doc_id"]).count() == 0
    f, c = toxicity.counted("aaaa")
    assert c.sum() == 4 + 3 + 2 and len(f) == 8


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data_is_the_patterns(documents):
    rng = random.Random(4)
    pieces = ["@", ".", "a", "b-c", "+", "1", "23", " ", "-", "(", ")", "255", "256", "4111111111111111", "a@b.c", "1.2.3.4", "é", "\n", "%", "_", "+44 20 7946 0958", "00"]
    texts = [*documents.text, *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(6000))]
    for t in texts:
        found = pii.find(t)
        for kind, (pattern, ok) in BASE.items():
            assert found[kind] == [m.span() for m in re.finditer(pattern, t) if ok(m.group())], (kind, t[:200])


def test_secrets_accounts_and_redaction():
    text = 'TOKEN = "40d78a45c418324758e0" and password: hunter22x IBAN DE89370400440532013000 https://me:pw@host/x mail a.b@c.org'
    found = pii.find(text)
    said = {k: [text[a:b] for a, b in v] for k, v in found.items()}
    assert said["secret"] == ["40d78a45c418324758e0", "hunter22x"] and said["account"] == ["DE89370400440532013000"] and said["url"] == ["https://me:pw@host/x"]
    clean = pii.redact(text, found)
    assert "a.b@c.org" not in clean and "[EMAIL]" in clean and "hunter22x" not in clean and clean.startswith('TOKEN = "[SECRET]" and')
    assert pii.find("a token of thanks = nothing") == {k: [] for k in pii.KINDS}


def test_personal_data_takes_linear_time():
    hostile = ["token=", "http://", "-eyJaaaaaaaa", "token=a", "http://u", "https://host/)", "a@", "+1(", "1.", "1 ", "-----BEGIN ", "account ", "iban DE", "sk-a", "x:eyJ.", "http:///u", "eyJaaaaaaaa.eyJ-"]
    for piece in (*hostile, *("account" + " " * n for n in (200, 5000))):
        text = piece * (1_000_000 // len(piece))
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 12, piece  # a second or two; this machine may be slow


def test_anchors_inside_a_run_are_seen():
    said = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t).items() if v}
    assert said("token=aaaaaaaaatoken= abc12345")["secret"] == ["abc12345"]
    assert said("http://a/http://me:pw1@host/x")["url"] == ["http://me:pw1@host/x"]
    assert said("http://a/u/users/jo,")["url"] == ["http://a/u/users/jo"]
    assert said("see http://a/http://b/users/jo.")["url"] == ["http://a/http://b/users/jo"]
    assert said("x-eyJaaaaaaaa-eyJbbbbbbbb.eyJcccccccc.dddddddd")["secret"] == ["eyJaaaaaaaa-eyJbbbbbbbb.eyJcccccccc.dddddddd"]
    assert said("eyJaaa-eyJbbbbbbbb.eyJcccccccc.dddddddd")["secret"] == ["eyJaaa-eyJbbbbbbbb.eyJcccccccc.dddddddd"]


def test_personal_data_edges(spark, edges, nothing):
    rows = pii.find_documents(edges).collect()
    assert len(rows) == edges.count() and pii.find_documents(nothing).count() == 0
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["n_email"], empty["base_sha256"], empty["spans"]) == (0, hashlib.sha256(b"").hexdigest(), "")
    redacted = pii.redact_documents(edges)
    assert redacted.columns == edges.columns and redacted.where("text is null").count() == 2


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &amp; two.<br>Three</p><p>Four</article><footer>f</footer>", "Title\nOne & two. Three\nFour"),
    ("<body><div class='ad'>Buy</div><main><p>a <b>b</b> c</p><ul><li>x<li>y</ul></main><div id=comments>no</div>", "a b c\nx\ny"),
    ("<header>Site</header><article><header><h1>Kept</h1></header><p>Body text</p></article>", "Kept\nBody text"),
    ("<body><article><p>a</p><script>if (1 < 2) { '</p>' }</script><style>p{}</style><form>f</form><p>b</p></article>", "a\nb"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
    ("<p>" + "x" * 100_000, "x" * 100_000),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>1 &lt; 2 &#233; &eacute; &nbsp; end</p></article>", "1 < 2 é é end"),
]


def test_main_text():
    for html, want in PAGES:
        assert html_extract.extract(html) == want, (html or "")[:80]


def test_main_text_of_pages(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    for html in pages.html:
        article = re.search(r"<article>(.*)</article>", html, re.S).group(1)
        words = re.sub(r"\s+", " ", html_extract.unescape(re.sub(r"<[^>]*>", " ", article))).split()
        assert html_extract.extract(html).split() == words
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((r["n_chars"], r["text"]) for r in html_extract.extract_pages(df).collect()) == [(0, ""), (0, ""), (1, "a")]
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    json.dumps(PAGES[0])


PROSE = "<p>" + "Some prose of an article that goes on for a while, with commas. " * 5 + "</p>"
LINE = " ".join(PROSE[3:-4].split())
NAMED = [
    (f"<body><div class='content no-sidebar'><article><h1>T</h1>{PROSE}</article></div></body>", ["T", LINE]),
    (f"<body><div class='widget-area'><article><h1>T</h1>{PROSE}</article></div><div class=widget>w</div></body>", ["T", LINE]),
    (f"<body><div class=has-share><div><h1>T</h1>{PROSE * 2}</div></div></body>", ["T", LINE, LINE]),
    (f"<body><article class='post comments-open'><h1>T</h1>{PROSE}</article></body>", ["T", LINE]),
    (f"<body><article><h2 id=related-work>Related</h2>{PROSE}<h2 id='search'>Search</h2><p id=notice>Notice</p></article></body>", ["Related", LINE, "Search", "Notice"]),
    (f"<body><form action=x><article><h1>T</h1>{PROSE}</article></form></body>", ["T", LINE]),
    (f"<body><article><p>See <a title='the hidden gem' href=x>this</a></p>{PROSE}<p hidden>x</p><p style='color:red; display: none'>y</p></article></body>", ["See this", LINE]),
    ("<body>" + f"<div class=widget>{PROSE}</div>" * 3 + "</body>", [LINE] * 3),
    (f"<body><article>{PROSE}<div class=share-buttons>Share</div><div class=relatedPosts>More</div><form>Mail</form><div id=comments><article class=comment>{PROSE * 3}</article></div></article></body>", [LINE]),
    ("<body><div class=ad>An advert longer than the article.</div><article><h1>Short</h1></article></body>", ["Short"]),
]


def test_names_cut_only_little_text_without_an_article():
    for html, want in NAMED:
        assert html_extract.extract(html).split("\n") == want, html[:80]


def test_heads_forms_and_names_lose_no_article():
    for html, want in [
        (f"<html><head><title>t</title><meta charset=utf-8><h1>T</h1>{PROSE}", ["T", LINE]),
        (f"<head><script>x</script><link href=a><body><nav>n</nav><div><h1>T</h1>{PROSE}</div>", ["T", LINE]),
        (f"<head><title>t</title>Loose text first. {PROSE}", ["Loose text first.", LINE]),
        (f"<body><form action=x><div><h1>T</h1>{PROSE * 3}</div></form></body>", ["T", *[LINE] * 3]),
        (f"<body><div class='social-history'><h1>T</h1>{PROSE}</div></body>", ["T", LINE]),
        (f"<article><div class='search-story related-reading'>{PROSE}</div>{PROSE}</article>", [LINE] * 2),
    ]:
        assert html_extract.extract(html).split("\n") == want, html[:80]


def test_pages_take_linear_time():
    for piece, end in [("<b>x", "</i>"), ("<b>", "<h1>x</h1>"), ("<b>", "<li>x"), ("<div>", "</span>"), ("<a", ""), ("<a", ">"), ("<![CDATA[", ""), ("<!--", ""), ("<p><td>", "<h2>y"), ("<script>", "</script "), ("<a b='", "\""), ("<article>", "</b>"), ("<ul><li>", "</p>"), ("&", "&amp")]:
        html = piece * 40_000 + end * 40_000
        began = time.process_time()
        html_extract.extract(html)
        assert time.process_time() - began < 15, (piece, end)


def plain_density(n, body):
    """Density of a node and of its text alone, by the written formula."""
    def inside(x):
        return [c for c in x.children if not isinstance(c, str)]

    def every(x):
        return [x, *(y for c in inside(x) for y in every(c))]

    def chars(x):
        return sum(len(c.strip()) if isinstance(c, str) else chars(c) for c in x.children)

    def in_links(x):
        return chars(x) if x.tag == "a" else sum(in_links(c) for c in inside(x))

    def density(x):
        c, t, lc, lt = chars(x), len(every(x)) - 1, in_links(x), sum(y.tag == "a" for y in every(x)[1:])
        if not c:
            return 0.0
        base = np.log(c / max(1, c - lc) * lc + in_links(body) / max(1, chars(body)) * c + np.e)
        ratio = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
        if base > 1:
            return c / max(1, t) * np.log(ratio) / np.log(max(base, 1 + 1e-9))
        return c / max(1, t) * np.log(max(np.e, c * max(1, t)))

    return density(n), sum(map(density, inside(n))) if inside(n) else density(n)


def test_densities_are_those_of_plain_code():
    rng = random.Random(13)

    def page(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randrange(0, 30)
        return "".join(rng.choice(["<div>{}</div>", "<p>{}</p>", "<a href=x>{}</a>", "<b>{}</b>", "{}"]).format(page(depth - 1)) for _ in range(rng.randrange(1, 4)))

    for _ in range(60):
        root = html_extract.parse(f"<body>{page(5)}</body>")
        order = html_extract._measure(root)
        plain = [plain_density(n, root) for n in order]
        assert np.allclose([(n.density, n.sum) for n in order], plain)
        text = html_extract.extract(f"<body>{page(4)}</body>")
        assert "<" not in text
        if root.chars:
            best = max(range(len(order)), key=lambda i: plain[i][1])
            assert max(order, key=lambda n: n.sum) is order[best] or np.isclose(max(n.sum for n in order), plain[best][1])


def test_main_without_an_article_is_taken_whole():
    sections = f"<h1>T</h1><section>{PROSE * 5}</section><section id=search><h2>Search</h2>{PROSE * 3}</section><ul><li>x</ul>"
    want = ["T", *[LINE] * 5, "Search", *[LINE] * 3, "x"]
    for html in (f"<body><main>{sections}</main></body>", f"<body><nav>n</nav><div><main><div>{sections}</div><div class=ad>Buy</div></main></div><footer>f</footer></body>"):
        assert html_extract.extract(html).split("\n") == want
    html = f"<body><main><p>Aside</p><article><h1>T</h1>{PROSE}</article></main></body>"
    assert html_extract.extract(html).split("\n") == ["T", LINE]


def test_personal_data_in_any_case_and_print():
    said = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.find(t).items() if v}
    assert said("İİ Social Security number: 123-45-6789")["account"] == ["123-45-6789"]
    assert said("sOcIaL sEcUrItY 123-45-6789, Api_Key = abc12345x") == {"account": ["123-45-6789"], "secret": ["abc12345x"]}
    for printed in ("GB29 NWBK 6016 1331 9268 19", "BE68 5390 0754 7034", "de89 3704 0044 0532 0130 00", "DE89370400440532013000"):
        for after in ("", " and more text", ", END 12", " UP"):
            assert said(f"Iban: {printed}{after}")["account"] == [printed], (printed, after)
    assert "account" not in said("IBAN GB28 NWBK 6016 1331 9268 19")
    body = "\n".join("MIIEpAIBAAKCAQEA7bq+/" * 3 for _ in range(3))
    block = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert pii.redact(f"a {block} b-c {block}", pii.find(f"a {block} b-c {block}")) == "a [SECRET] b-c [SECRET]"
    cut = block[: block.index("\n-----END")]
    assert pii.redact(f"{cut}\n\nprose\n{block}", pii.find(f"{cut}\n\nprose\n{block}")) == "[SECRET]\n\nprose\n[SECRET]"
    many = "-----BEGIN PRIVATE KEY-----\nx " * 20_000
    assert len(pii.find(many)["secret"]) == 20_000
    assert pii.find("IBAN DE\u212a9370400440532013000 IBAN \u01309370400440532013000")["secret"] == []
