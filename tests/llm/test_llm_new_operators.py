"""Whitening, tokenizer alignment and main-text extraction against brute force and edge cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from fairlead.llm import align, htmltext, tables, whiten

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EMB = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    tables.prepare_session(spark)


# ---- whitening

def _plain_whitening(vectors, count):
    x = np.array([np.floor(np.asarray(v, dtype=np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return x, n, s, e[order], q[:, order][:, :count], e.sum()


def test_whitening_matches_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(12, 12))
    vectors = (rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)) @ basis / 8
    rows = [(i, [float(v) for v in vec], 0) for i, vec in enumerate(vectors)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(40)]                 # repeated vectors count once in the fit
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 10, 0), (2002, [float("nan")] * 12, 0), (2003, [0.5] * 11, 0),
             (2004, [float("inf")] + [0.0] * 11, 0), (None, rows[5][1], 0)]
    got = whiten.whiten(spark.createDataFrame(rows, EMB), components=5).toPandas()
    x, n, s, e, q, trace = _plain_whitening([r[1] for r in rows[:300]], 5)
    assert set(got.vec_id.dropna()) == set(range(300)) | set(range(1000, 1040))
    assert len(got) == (341) * 5 and (got.n == n).all()
    for k in range(5):
        part = got[got.component == k + 1].dropna(subset=["vec_id"]).sort_values("vec_id")
        part = part[part.vec_id < 300]
        want = (x - s / n) @ q[:, k] / math.sqrt(e[k])
        sign = np.sign(want[0]) * np.sign(part.whitened.values[0])
        assert np.allclose(part.whitened.values, sign * want, atol=1e-8)
        assert abs(part.explained.values[0] / (e[k] / trace) - 1) < 1e-9
        assert list(part.deviation.values) == [int(v) for v in ((n * x - s) ** 2).sum(1)]
    assert got.identity_error.max() < 1e-9


def test_whitening_of_few_dimensions_and_edges(spark):
    flat = [(i, [float(i % 7) / 64, float(i % 7) / 32, 0.25], 0) for i in range(50)]   # rank one
    got = whiten.whiten(spark.createDataFrame(flat, EMB)).toPandas()
    assert set(got.component) == {1} and len(got) == 50 and abs(got.explained.iloc[0] - 1) < 1e-12
    same = [(i, [0.5, 0.25], 0) for i in range(5)]
    assert whiten.whiten(spark.createDataFrame(same, EMB)).count() == 0
    assert whiten.whiten(spark.createDataFrame([], EMB)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None, 0)], EMB)).count() == 0
    clash = spark.createDataFrame(flat, EMB).selectExpr("*", "'x' as whitened", "1 as _x", "2 as n")
    got = whiten.whiten(clash).toPandas()
    assert got.whitened.dtype == float and (got.n == 7).all() and "_x" in got.columns


# ---- alignment

def _plain_alignment(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = align.byte_alphabet()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    per, counts = [], collections.Counter()
    for text in texts:
        if not text:
            per.append(None)
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        sa, sb, pos = [], [], 0
        for i, t in zip(e.ids, e.tokens):
            raw = bytes(alphabet[c] for c in t)
            sa.append((i, pos, pos + len(raw)))
            pos += len(raw)
        pos = 0
        for i in b.encode(text):
            raw = b_bytes(i)
            sb.append((i, pos, pos + len(raw)))
            pos += len(raw)
        target = (" " + text).encode()
        if sa[-1][2] != len(target) or sb[-1][2] != len(target):
            per.append(None)
            continue
        links = [(i, j) for i, a0, a1 in sa for j, b0, b1 in sb if max(a0, b0) < min(a1, b1)]
        counts.update(links)
        cuts, prev, parts = sorted({t[2] for t in sa} & {t[2] for t in sb}), 0, []
        for cut in cuts:
            parts.append(",".join(str(i) for i, _, e in sa if prev < e <= cut) + "|" + ",".join(str(i) for i, _, e in sb if prev < e <= cut))
            prev = cut
        per.append((len(sa), len(sb), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (i, j), c in counts.items():
        best[j] = max(best[j], c)
    out = []
    for r in per:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, ng, links, digest = r
            out.append((na, nb, ng, len(links), sum(counts[l] == best[l[1]] for l in links), sum(counts[l] for l in links), digest))
    return out


def test_alignment_matches_brute_force(spark):
    import public_tokenizers as P

    rng = random.Random(5)
    words = "the ünïcode naïve café 東京 was 😀 running, quickly! <|endoftext|> <s> 12345 don't   tabs\tend".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts += [None, "", "  ", "x", texts[0], " non breaking", "é composed", "ﬁ ligature"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[1], None, None, None)]
    got = align.align(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as keys", "'z' as n_best"),
                      P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).toPandas()
    want = _plain_alignment([r[1] for r in rows])
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got[cols].itertuples(index=False)) == sorted(want)
    assert len(got) == len(rows) and "lang" in got.columns and "text" not in got.columns
    empty = got[got.doc_id.isin([30, 31])]
    assert (empty.n_a == 0).all() and (empty.groups_sha256 == "").all()
    assert align.align(spark.createDataFrame([], DOCS), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_hot_pairs_are_salted_without_loss(spark, monkeypatch):
    import public_tokenizers as P

    texts = ["the the the cat"] * 60 + ["a dog ran the"] * 3
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(align, "HOT_SHARE", 1 / 4)
    got = align.align(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).toPandas()
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got[cols].itertuples(index=False)) == sorted(_plain_alignment(texts))


def _library(path):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    return a


def test_fast_encoder_gives_the_librarys_ids():
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    a = _library(path)
    encode = align._encoder(path, a)
    assert align._mergeable_ranks(path, a) is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" {c}{c}a{c}1 {c}\n{c}!" for c in points[i:i + 2000]) for i in range(0, len(points), 2000)]
    rng = random.Random(9)
    for letters in ("ab", "aab", "theing ", "01", " \n\t", "é東ñ😀", "!-=_*'s"):
        texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 7, 120, 700, 3000) for _ in range(5)]
    texts += [" <|endoftext|>x<|endoftext|>", "a" * 5000, "", " " * 5]
    assert [t[:20] for t in texts if encode(t) != a.encode(t, add_special_tokens=False).ids] == []


def test_long_runs_of_white_space_are_encoded_by_the_library():
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    a = _library(path)
    text = "x" + " " * 1_500_000 + "y"
    assert align._encoder(path, a)(text) == a.encode(text, add_special_tokens=False).ids


def test_other_vocabulary_files_keep_the_library(tmp_path):
    import json

    import public_tokenizers as P

    spec = json.load(open(P.path("byte_bpe_50k.json")))
    odd = [lambda s: s["model"]["merges"].reverse(), lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
           lambda s: s.update(normalizer={"type": "Lowercase"}), lambda s: s["model"]["merges"].pop()]
    for k, change in enumerate(odd):
        other, path = json.loads(json.dumps(spec)), str(tmp_path / f"{k}.json")
        change(other)
        json.dump(other, open(path, "w"))
        a = _library(path)
        assert align._mergeable_ranks(path, a) is None
        assert align._encoder(path, a)(" Some Text") == a.encode(" Some Text", add_special_tokens=False).ids


def test_byte_alphabet_is_a_bijection():
    table = align.byte_alphabet()
    assert len(table) == 256 and sorted(table.values()) == list(range(256)) and table["Ġ"] == 32


# ---- main text

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t=\"</p>\";</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><div class=\"ad\">Buy now cheap</div>"
        "<header>Site name</header><article><h1>The title &amp; more</h1><p>First   paragraph\n with <b>bold</b> words that carry"
        " the story along for a while.</p><p>Second paragraph, also long enough to be content text here.</p>"
        "<div id=\"comments\"><p>Great post!</p></div><form><input name=q>Search</form></article>"
        "<aside>Related links</aside><div role=\"contentinfo\">notice</div><footer>&copy; 2024 site</footer></body></html>")


def test_main_text_of_a_page():
    assert htmltext.main_text(PAGE) == ("The title & more First paragraph with bold words that carry the story along for a while. "
                                        "Second paragraph, also long enough to be content text here.")


def test_main_text_edges():
    assert htmltext.main_text(None) == "" and htmltext.main_text("") == ""
    assert htmltext.main_text("<script>only()</script>") == ""
    assert htmltext.main_text("plain text &lt;b&gt; only") == "plain text <b> only"
    assert htmltext.main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert htmltext.main_text("<div hidden>gone</div><p>kept  text</p>") == "kept text"
    long = "<article>" + "<p>" + "word " * 200 + "</p>" * 1 + "".join(f"<p>para {i} " + "x " * 50 + "</p>" for i in range(3000)) + "</article>"
    got = htmltext.main_text(long)
    assert got.startswith("word word") and got.endswith("x x") and got.count("para ") == 3000


def test_link_lists_are_dropped_by_their_ratio():
    links = "<div>" + " ".join(f"<a href='/{i}'>l{i}</a>" for i in range(30)) + "</div>"
    page = f"<body>{links}<div><p>{'Real sentence of the article body. ' * 20}</p><p>{'More words follow here. ' * 20}</p></div>{links}</body>"
    got = htmltext.main_text(page)
    assert got.startswith("Real sentence") and "l1 " not in got and got.endswith("follow here.")


def test_extract_frame(spark):
    rows = [(1, "u1", PAGE), (2, "u2", None), (2, "u2", None), (None, None, "<p>x &eacute;</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "5 as n_chars", "'y' as text")
    got = sorted(htmltext.extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.n_chars for r in got] == [len(got[0].text), 0, 0, 3] and got[3].text == "x é" and got[1].text == ""
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
