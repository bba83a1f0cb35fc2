"""Corpus operators against brute force, exact round trips and edge cases."""

import base64
import gzip
import hashlib
import math
import random
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import bpe, components, decontaminate, langid, outliers, pii, secretscan, simhash, slots, tables, toxicity, warc
from fairlead.session import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is was for that with on are by from this have not but what all were when your can said there use".split()


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    tables.prepare_session(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "er", "ly", "."]) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty, blank and long texts, repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(9000))
    return [(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0), (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", len(long)),
            (5, "a b c", "en", "s", 5), (5, "a b c", "en", "s", 5), (6, "a b c", "fr", "t", 5), (None, "a b c", "fr", "t", 5),
            (7, "\x00 émoji 😀 𝒳 <|endoftext|> x", "en", "s", 3)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """More columns, with names the operators use inside."""
    return df.selectExpr("*", "1 as id", "2 as fp", "'x' as kept", "3 as ids", "4 as pii_kinds", "5 as pool", "6 as row", "'k' as key")


# ---- sharding

def test_slots_balance_and_number(spark, edges, empty):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400), "en", "s", 0) for i in range(3000)]
    got = slots.shard_documents(spark.createDataFrame(rows, DOCS), 8, 512).collect()
    loads, places = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 3000 and max(loads.values()) - min(loads.values()) <= 401
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.shard_documents(empty).count() == 0
    odd = slots.shard_documents(clashing(edges)).collect()
    assert len(odd) == len(edge_rows()) and {r["size"] for r in odd if r["doc_id"] == 1} == {1}


def test_slot_map_matches_greedy_and_grows(spark):
    rng = random.Random(2)
    sizes = {s: rng.choice([0, 5, 5, 9, rng.randint(1, 500)]) for s in range(64)}
    totals = spark.createDataFrame([(s, b, 1) for s, b in sizes.items()], "vslot int, bytes bigint, n_rows bigint")
    first = slots.first_map(totals, 4)
    loads, want = [0] * 4, {}
    for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
        want[s] = loads.index(min(loads))
        loads[want[s]] += sizes[s]
    assert {r["vslot"]: r["shard"] for r in first.collect()} == want
    folder = fresh_path(spark, "map")
    slots.write_map(first, folder)
    grown = slots.grown_map(slots.read_map(spark, folder), totals, 4)
    slots.write_map(grown, folder)
    new = {r["vslot"]: r["shard"] for r in slots.read_map(spark, folder).collect()}
    assert all(new[s] in (want[s], 4) for s in want) and 4 in new.values()
    assert {r["vslot"]: r["shard"] for r in slots.read_map(spark, folder, 1).collect()} == want
    share = [sum(sizes[s] for s in new if new[s] == k) for k in range(5)]
    # An old shard keeps no more than an even share; each hands over less than one slot too much.
    assert max(share[:4]) <= sum(sizes.values()) / 5 and share[4] <= sum(sizes.values()) / 5 + 4 * 500


# ---- pseudonyms

VALUES = ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "+1 (017) 555-7713", "+493012345678", "10.0.0.255", "123-45-6789",
          "2020-02-29", "31/12/1999", "01.02.1850", "DE89370400440532013000", "GB82WEST12345698765432", "a.34@mail7.example.com"]
INVALID = ["4111111111111112", "256.1.1.1", "000-12-3456", "2021-02-29", "45/45/2000", "DE88370400440532013000", "1234", "1650-01-01"]


def test_pseudonyms_keep_format_and_undo(spark):
    rows = [(i, f"x {v}, {v}. y") for i, v in enumerate(VALUES + INVALID)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = pii.pseudonymise(df, "key")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "key", undo=True).collect()}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "another key").collect()}
    shape = lambda t: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in t)
    for i, text in rows:
        value = (VALUES + INVALID)[i]
        if value in VALUES:
            first, second = got[i][2:-3].split(", ")
            assert first == second != value and back[i] == text and other[i] != got[i], value
            if value != "10.0.0.255":
                assert shape(got[i]) == shape(text)
        else:
            assert got[i] == text, value


def test_pseudonyms_are_a_permutation(spark):
    df = spark.range(100, 900).selectExpr("id as doc_id", "concat(id, '-12-3456') as text")
    kept = {r["text"] for r in pii.pseudonymise(df, "k").collect()}
    valid = [i for i in range(100, 900) if i != 666]
    assert len(kept) == 800 and "666-12-3456" in kept and len(valid) == 799
    for t in kept - {"666-12-3456"}:
        a, g, s = t.split("-")
        assert a not in ("000", "666") and a < "900" and g != "00" and s != "0000"


def test_pseudonym_edges(edges, empty):
    out = pii.pseudonymise(clashing(edges), "k")
    assert out.count() == len(edge_rows()) and pii.pseudonymise(empty, "k").count() == 0
    want = sorted(((r[0], r[1]) for r in edge_rows()), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=repr) == want


# ---- BPE

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tree_join_is_exact(library):
    tok, rng = bpe.tokenizer(*bpe.vocabulary()), random.Random(5)
    kinds = ["ab", "abcdefghij '", "a", "'s re ll", "  \n\t", "字漢é語", "01 2", "!?.'", "a b'srelvm \n1é字!", "the of and ing"]
    for _ in range(150):
        text = ""
        while len(text) < rng.randint(20, 1500):
            text += rng.choice(["", "<|endoftext|>", "'s", "'re", " ", "\n\n"]) + "".join(
                rng.choice(rng.choice(kinds)) if rng.random() < 0.1 else rng.choice(kinds[2:4][rng.random() < 0.5]) for _ in range(rng.choice([5, 50, 300])))
        parts = tok.pieces(text, rng.choice([1, 3, 7, 20, 100]))
        assert "".join(parts) == text
        ids = tok.join_all([(p.encode(), np.asarray(tok.encode(p), dtype=np.int64)) for p in parts])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert tok.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_text(library):
    tok = bpe.tokenizer(*bpe.vocabulary())
    for text in ("ab" * 20000, "字" * 9000, " " * 30000 + "x", "=" * 12345, "a1" * 8000):
        parts = tok.pieces(text, 500)
        ids = tok.join_all([(p.encode(), np.asarray(tok.encode(p), dtype=np.int64)) for p in parts])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark, edges, empty, library):
    vocab = bpe.vocabulary()
    out = bpe.decode(bpe.encode(clashing(edges), vocab, split=1000), vocab)
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["decoded"]) for r in out.collect())
    want = Counter((r[0], r[1], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in edge_rows())
    assert got == want
    assert bpe.encode(empty, vocab).count() == 0


# ---- SimHash

def brute_fingerprint(text, n=4):
    from xxhash import xxh64_intdigest
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(keys, linked):
    root = {k: k for k in keys}
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def test_fingerprints_match_brute_force():
    rng = random.Random(3)
    for text in [None, "", " \x1c ", "One", "a\x0bB c", prose(rng, 3), prose(rng, 4), prose(rng, 300), "É é \x85 x y", edge_rows()[4][1]]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_golay_code_covers():
    values = np.random.default_rng(0).integers(0, 1 << 23, 300).astype(np.uint64)
    for bits in (2, 4, 8):
        row, key, home = simhash.anchors(values, bits)
        first = key < 1 << 23
        assert (np.bincount(row[first & home], minlength=300) == 1).all()
        away = np.bitwise_count((key[first] ^ values[row[first]].astype(np.int64)).astype(np.uint64))
        assert (away[home[first]] <= 3).all() and away.max() <= 3 + simhash.allowances(bits)[0]


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_match_all_pairs(spark, tile):
    rng = random.Random(tile)
    values = set()
    for _ in range(120):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    a = np.array(sorted(values), dtype=np.uint64)
    signed = a.view(np.int64).tolist()
    pairs = [(signed[i], signed[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4)]
    want = classes_of(signed, pairs)
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4, tile)
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {k: root.get(k, k) for k in signed} == want


def test_near_duplicate_groups(spark, edges, empty):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        words = prose(rng, 200).split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(200)] = "other"
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = classes_of(list(fps), [(i, j) for i in fps for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert got == want
    odd = simhash.near_duplicates(clashing(edges)).collect()
    assert len(odd) == len(edge_rows()) and {r["component_id"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# ---- WARC

def test_warc_ranges_agree_and_dedup(spark):
    text = "x" * 200 + "é"
    rows = [(i, f"u{i}" if i % 3 else None, text if i % 2 else f"y{i}") for i in range(60)]
    rows += [(None, None, None), (None, "a b\nc", text), (3, "q", text), (70, "v", "z" * 100), (70, "v", "z" * 100), (61, "w", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages.withColumn("payload", F.lit(1)), fresh_path(spark, "warc"), most_bytes=3000)
    wanted = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None) if len(body) >= 100 else None
        later = first is not None and page != first
        wanted[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", first if later else None] += 1
    for split in (50, 997, 1 << 20):
        records = warc.read_archives(manifest, split).collect()
        got = Counter((r["page_id"], len(r["payload"]) if r["payload"] is not None else r["stored_length"],
                       hashlib.sha256(r["payload"]).hexdigest() if r["payload"] is not None else r["stored_digest"],
                       r["record_type"], r["refers_to"]) for r in records)
        assert got == wanted
    for path in [r["path"] for r in manifest.collect()]:
        assert gzip.decompress(open(path.removeprefix("file:"), "rb").read()).startswith(b"WARC/1.0\r\n")
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_warc_ignores_false_magic(tmp_path):
    one = lambda body: gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n", mtime=0)
    inner = warc.MAGIC + b"junk" + gzip.compress(b"no record", mtime=0)
    stored = gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 40\r\n\r\n" + inner, compresslevel=0, mtime=0)
    data = one(b"first") + stored + one(b"last")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for split in (1, 7, 64, 10_000):
        with open(path, "rb") as handle:
            found = [at for s in range(0, len(data), split) for at, _ in warc.RangeReader(handle, len(data)).records(s, min(s + split, len(data)))]
        assert found == [0, len(one(b"first")), len(data) - len(one(b"last"))]


# ---- secrets

def test_base_spans_match_a_plain_reading():
    import re
    rng = random.Random(4)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "ſecret", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEF0123456789",
            "x", "-", "..", "hunter2hunter2", "\n", "é"]
    plain = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        want = [(m.start(), 0, m.end()) for m in plain.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secretscan.base_spans(text) == sorted(want)


def test_layers_are_unwrapped_and_mapped():
    secret = "password = 'hunter2hunter2X'"
    b64 = lambda b: base64.b64encode(b if isinstance(b, bytes) else b.encode()).decode()
    quoted = urllib.parse.quote(secret, safe="")
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    nested = b64(gzip.compress(b64(quoted).encode()))
    for layer in (b64(secret), quoted, escaped, b64(gzip.compress(secret.encode())), nested, urllib.parse.quote(urllib.parse.quote(nested)), b64(b64(b64(secret)))):
        text = f"né {layer} end"
        base, more, cut = secretscan.scan(text)
        assert not base and not cut and more, layer
        for a, kind, b in more:
            assert kind == 0 and 3 <= a < b <= 3 + len(layer)
        assert "hunter" not in "".join(str(secretscan.scan(secretscan.redacted(text))[:2]))
        assert secretscan.scan(secretscan.redacted(text))[:2] == ([], [])
    start = quoted.index("password")
    assert secretscan.scan(quoted)[1] == [(start, 0, quoted.index("X") + 1)]


def test_layers_end_and_stay_quiet():
    assert secretscan.scan("%25%32%35" * 50 + "\\u005cu005c" * 20)[1] == []
    assert secretscan.scan(base64.b64encode(bytes(range(256))).decode())[1] == []
    big = base64.b64encode(gzip.compress(b"a" * (secretscan.MOST_UNFOLDED + 10))).decode()
    assert secretscan.scan(big)[2]


def test_large_layers_are_scanned_whole():
    secret = " password = 'hunter2hunter2X' "
    b64 = lambda b: base64.b64encode(b).decode()
    for filler in ("- " * (17 << 20), "a" + " \u00e9" * (12 << 20)):
        text = "x " + b64(gzip.compress((filler + secret).encode(), 1)) + " y"
        assert secretscan.scan(text)[1:] == ([(2, 0, len(text) - 2)], True)
    for k in range(secretscan.CHUNK - 40, secretscan.CHUNK + 4, 3):  # over the edge of a chunk
        assert secretscan.scan(b64(gzip.compress(("- " * (k // 2) + secret).encode(), 1)))[1]


def test_layers_are_found_where_they_begin():
    secret = "password = 'hunter2hunter2X'"
    b64 = lambda b: base64.b64encode(b).decode()
    packed = b64(zlib.compress(b"x" * 30 + secret.encode())), b64(gzip.compress(secret.encode()))
    noise = bytes(random.Random(5).randrange(256) for _ in range(300)).hex().upper()
    wrapped = base64.encodebytes(b"some words before it, so that it goes over a line " * 1 + b"...." + secret.encode()).decode()
    lines = base64.encodebytes(gzip.compress(bytes.fromhex(noise) + secret.encode())).decode()
    members = b64(gzip.compress(b"first") + gzip.compress(secret.encode()))
    texts = ["https://h/x/" + b64(secret.encode()), "key-" + packed[1], "https://h/x/" + packed[0], "ab/" + packed[1] + "\n", wrapped, lines, members,
             b64(b"\xff\x00\x1b" + secret.encode()), "%FF" + "".join(f"%{c:02x}" for c in secret.encode())]
    for text in texts:
        assert [k for _, k, _ in secretscan.scan(text)[1]] == [0], text
        assert secretscan.scan(secretscan.redacted(text))[:2] == ([], []), text


def test_secret_frames(edges, empty):
    out = secretscan.scan_secrets(clashing(edges)).collect()
    assert len(out) == len(edge_rows()) and secretscan.scan_secrets(empty).count() == 0
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in out if r["doc_id"] in (1, 2, 3))
    assert secretscan.redact(edges).where("text is null").count() == 2


# ---- toxicity

def test_composed_machine_equals_cascade():
    rng = random.Random(8)
    machines = [toxicity.negation_machine(), toxicity.report_machine(), toxicity.target_machine()]
    for _ in range(300):
        symbols = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(1, 15))]
        plain = symbols
        for m in machines:
            state, out = m.start, []
            for s in plain:
                state, o = m.step(state, s)
                out.append(o)
            plain = out
        state, got = toxicity.GRAMMAR.start, []
        for s in symbols:
            state, o = toxicity.GRAMMAR.step(state, s)
            got.append(o)
        assert got == plain


def test_settings_of_an_insult():
    lexicon = toxicity.Lexicon({})
    at = lambda text: {o for o, v in zip(toxicity.OUTPUTS, toxicity.features(text, lexicon)) if v}
    assert at("you are an idiot") == {"insult+"} and at("what an idiot") == {"insult"} and at("not an idiot here") == {"insult-"}
    assert at("they said an idiot came") == {"insult~"} and at("idiot, you there") == {"insult"} and at("idiot you are") == {"insult", "aimed"}
    assert at("i will kill you") == {"threat", "aimed"} and at("nothing here") == set()


def test_toxicity_learns_stems(spark, edges, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grubl" + rng.choice(["ing", "ed", "er", "os", "ik"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert any("grubl".startswith(s[:5]) for s in model.stems)
    assert toxicity.reject(docs, model).count() == sum(1 - r["predicted"] for r in got.values())
    odd = toxicity.score(clashing(edges), model).collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# ---- language

def test_forward_sums_all_segmentations():
    import itertools
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = langid.vocabulary(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size())
                     if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
    pieces = [p for p in pieces if p == langid.START or langid.LETTERS.fullmatch(p.removeprefix(langid.START))]
    number = {p: i for i, p in enumerate(pieces, 1)}
    prob = np.vstack([np.random.default_rng(0).random((vocab.size, 3)) * 1e-3, np.zeros(3)])
    for word in ("hello", "été", "字a", "x", "thand"):
        text, total, uses = langid.START + word, np.zeros(3), Counter()
        flat = lambda i: 1e-5 if i == 0 else 1e-4
        weight = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            ids = [number.get(text[a:b], 0 if b == a + 1 else None) for a, b in zip(at, at[1:])]
            if None not in ids:
                total += np.prod([prob[i] for i in ids], axis=0)
                w = math.prod(map(flat, ids))
                weight += w
                for i in ids:
                    uses[i] += w
        assert np.allclose(langid.word_scores([word], vocab, prob)[0], np.log(total), rtol=1e-5)
        counts = langid.expected_counts(Counter({word: 3}), vocab)
        assert all(math.isclose(counts[i], 3 * v / weight, rel_tol=1e-6) for i, v in uses.items())
    assert np.isfinite(langid.word_scores(["ab" * 2000], vocab, prob)).all()


def test_languages_are_told_apart(spark, edges, empty):
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(2)
    other = [w[::-1] + "o" for w in WORDS]
    rows = [(i, " ".join(rng.choice(WORDS if i % 3 else other) for _ in range(30)), "aa" if i % 3 else "bb", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.where("doc_id < 100"), path)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.where("doc_id >= 100"), model).collect()}
    assert all(got[r[0]] == r[2] for r in rows[100:])
    odd = langid.predict(clashing(edges), model).collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.predict(edges, langid.fit(empty, path)).where("lang_pred <> 'und'").count() == 0


def test_copies_do_not_thin_the_training_texts(spark):
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"{a}{b}" for a in WORDS for b in WORDS[:4]]
    plain = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    copies = plain.unionByName(spark.range(20000).selectExpr("'the same line' as text", "'aa' as lang"))
    once = plain.unionByName(spark.range(1).selectExpr("'the same line' as text", "'aa' as lang"))
    got, want = langid.fit(copies, path, most=500), langid.fit(once, path, most=500)
    assert np.allclose(got.prob, want.prob)


# ---- quality

def brute_statistics(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_statistics_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a b c d e ", "x", " ", "\n", "é#", "|", "\x0b", "\x1c", "😀 ", "a b c d e\n"]) for _ in range(rng.randint(0, 30)))
        assert outliers.statistics(text)[:5] == brute_statistics(text), text
    assert outliers.statistics(None)[:5] == (0,) * 5


def brute_mcd(v, steps=outliers.STEPS, share=outliers.SHARE):
    """The same concentration steps on one array."""
    floors = np.array(outliers.FLOORS)
    q = np.quantile(v, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    mean, prec = q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)
    bins = lambda d: np.clip(np.floor(np.log2(d + 1e-12) * outliers.PER_OCTAVE), outliers.LOWEST, outliers.HIGHEST)
    distance = lambda: np.einsum("ij,jk,ik->i", v - mean, prec, v - mean)
    def inner(part):
        b = bins(distance())
        values, counts = np.unique(b, return_counts=True)
        return b, values[np.cumsum(counts) - counts < part * len(v)].max()
    for _ in range(steps):
        b, edge = inner(share)
        near = v[b <= edge]
        mean = near.mean(axis=0)
        prec = np.linalg.inv((near.T @ near) / len(near) - np.outer(mean, mean) + np.diag(floors**2))
    _, edge = inner(0.5)
    return distance() / max(1.0, 2 ** ((edge + 1) / outliers.PER_OCTAVE) / outliers.CHI2_MEDIAN)


def test_mcd_matches_plain_steps_and_rejects(spark, edges, empty):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        words = prose(rng, rng.randint(30, 200)).split()
        if i % 9 == 0:
            words = [w + rng.choice(["###", "%%%", "***"]) for w in words]
        rows.append((i, " ".join(words), "en", "s" if i < 600 else f"t{i % 4}", 0))
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, DOCS)).collect()}
    for some in (range(600), range(600, 900)):  # the small sources share a pool
        stats = np.array([outliers.statistics(rows[i][1]) for i in some])
        ok = ~outliers.failed(stats[:, 0], stats[:, 4])
        assert np.allclose([got[i]["distance"] for i, k in zip(some, ok) if k], brute_mcd(outliers.vectors(stats[ok])), rtol=1e-6)
    assert all(got[i]["kept"] == (i % 9 != 0) for i in range(900) if not got[i]["base_failed"])
    odd = outliers.judge(clashing(edges)).collect()
    assert len(odd) == len(edge_rows()) and not any(r["kept"] for r in odd if r["doc_id"] in (None, 1, 2, 3, 5, 6))
    assert outliers.judge(empty).count() == 0


# ---- decontamination

def test_passages_are_found_and_exact(spark, edges, empty):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in WORDS for b in ("", "x", "ly", "or", "ent", "ish")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 15, 30, 55])))) for i in range(60)] + [(99, None), (98, "")]
    prepared = decontaminate.prepare(items)
    rows, planted = [], {}
    for d in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if d % 2:
            item = rng.choice([i for i, t in items if t and len(t.split()) >= 5])
            passage = items[item][1].split()
            for _ in range(rng.randint(0, len(passage) // 5)):
                at = rng.randrange(len(passage))
                op = rng.choice("rdi")
                passage[at:at + (op != "i")] = [] if op == "d" else [rng.choice(vocabulary)]
            at = rng.randint(0, len(words))
            words[at:at] = passage
            planted[d] = item
        rows.append((d, " ".join(w.upper() if d % 5 == 0 else w for w in words), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = {}
    for d, text, *_ in rows:
        w = np.array([prepared.vocabulary.get(x, -1) for x in decontaminate.words_of(text)], dtype=np.int64)
        for i, item in zip(prepared.ids, prepared.words):
            distance = decontaminate.passage(item, w)[0]
            if distance <= int(0.2 * len(item)):
                want[d, i] = distance
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(want) >= len(planted) * 0.95
    clean = {r["doc_id"] for r in decontaminate.without_passages(docs, benchmark).collect()}
    assert clean == {r[0] for r in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(clashing(edges), benchmark).count() == 0
    assert decontaminate.contaminated(edges, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(empty, benchmark).count() == 0


@pytest.mark.parametrize("n", [5, 10, 20, 29, 30, 60, 120, 250, 400])
def test_recall_at_all_edits_for_each_length(n):
    rng = random.Random(n)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i in range(max(20, min(100, 3000 // n)))]
    texts = []
    for _, item in items:
        passage = item.split()
        for _ in range(n // 5):
            at, op = rng.randrange(len(passage)), rng.choice("rdi")
            passage[at:at + (op != "i")] = [] if op == "d" else [rng.choice(vocabulary)]
        texts.append(" ".join([*rng.choices(vocabulary, k=50), *passage, *rng.choices(vocabulary, k=50)]))
    found = {hit[:2] for hit in decontaminate.find(decontaminate.prepare(items), texts)}
    assert len(found & {(i, i) for i, _ in items}) >= 0.97 * len(items)


def test_items_go_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(7)]
    docs = spark.createDataFrame([(i, "a b " + t + " c", "en", "s", 0) for i, t in items], DOCS)
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i, _ in items}


def test_passage_distance_matches_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 8))])
        region = np.array([rng.randrange(4) for _ in range(rng.randint(0, 14))], dtype=np.int64)
        def edit(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                prev, row = row, [i]
                for j, y in enumerate(b, 1):
                    row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            return row[-1]
        best = min(edit(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        distance, start, end = decontaminate.passage(item, region)
        assert distance == best == edit(item, region[start:end])
