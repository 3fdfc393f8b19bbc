import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basalt.llm import decontaminate, lines, mixing, near, quality, tokens, urls, warc
from basalt.llm.common import Workspace
from basalt.llm.words import LINE_FEED, NO_WORD, blocks, numbered, numbered_shingles, shingles

from llm_helpers import contamination, fill, texts, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.text(alphabet="aB3é日! \n\x00_", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles(column):
    seen = {}
    for chunk in (1, 1 << 20):
        for b in blocks(pa.array(column, pa.string()), chunk=chunk):
            grams, at = shingles(b.hashes, b.at, 5)
            for r in range(b.hi - b.lo):
                w = words(column[b.lo + r])
                assert len(w) == b.at[r + 1] - b.at[r]
                for x, h in zip(w, b.hashes[b.at[r] : b.at[r + 1]].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
                want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
                for x, h in zip(want, grams[at[r] : at[r + 1]].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum([0, *steps])
    ef = tokens.EliasFano.encode(values)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    assert (len(ef.low) + len(ef.upper)) * 8 <= len(values) * (2 + max(1, math.ceil(math.log2(max(values[-1] / len(values), 1))))) + 80


def test_encoder_is_the_librarys():
    rng = random.Random(5)
    library = Tokenizer.from_file(TOKENIZER)
    encoder = tokens.Encoder(open(TOKENIZER, encoding="utf-8").read(), memo=50)
    assert encoder.cuts
    some = ["", " ", "<|endoftext|> <|ENDOFTEXT|>x", "it's IT'S we'LL", "a\x1cb \x00", "É é ÷×ß", "ÀÉ", "e\u0301 \u0301a", "日本", "12ab3.,!?a_b", *("".join(rng.choice("aB3 é'<|>\n\t\x1c\u0301.,!_-5\x85Σςſ") for _ in range(rng.randrange(60))) for _ in range(400))]
    got = []
    for _, ids, ends in encoder.encode(pa.array(some)):
        got += [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    other = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder = tokens.Encoder(other)
    got = [ids.tolist() for _, ids, _ in encoder.encode(pa.array(["It's a Test, 12!"]))]
    assert not encoder.cuts and got == [Tokenizer.from_str(other).encode("It's a Test, 12!", add_special_tokens=False).ids]


def test_token_files(spark, docs, empty, odd_ids):
    library = Tokenizer.from_file(TOKENIZER)
    ws = Workspace(spark, "test")
    tokens.write(docs, f"{ws.path}/a", TOKENIZER, segment_ids=500, block_bytes=2000)
    start, want = 0, []
    for d, t in sorted(texts(docs).items()):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.offsets(tokens.read(spark, f"{ws.path}/a")).collect()) == want
    files = [tokens.Segment(bytes(r["content"])) for r in spark.read.format("binaryFile").load(f"{ws.path}/a").where("length > 0").collect()]
    assert len(files) > 5
    by_id = texts(docs)
    for s in files:
        i = s.n - 1
        assert s.document(i).tolist() == [*library.encode(by_id[int(s.doc_ids[i])], add_special_tokens=False).ids, 1]
    tokens.write(empty, f"{ws.path}/b", TOKENIZER)
    assert tokens.offsets(tokens.read(spark, f"{ws.path}/b")).collect() == []
    tokens.write(odd_ids, f"{ws.path}/c", TOKENIZER)
    assert sorted(((r["doc_id"], r["start"]) for r in tokens.offsets(tokens.read(spark, f"{ws.path}/c")).collect()), key=lambda r: r[1])[0] == (None, 0)


def archive(spark, pages, **options):
    ws = Workspace(spark, "test")
    warc.write(pages, f"{ws.path}/w", **options)
    return warc.read(spark, f"{ws.path}/w"), ws


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\nWARC/1.0\r\n"
    rows = [(5, "http://a.b/x?q=1", "same"), (3, "https://c.d", "same"), (9, None, "same"), (4, "no url", None), (6, "http://e\r\nX: y", ""), (7, "http://ü/é", tricky), (8, "http://f", "é" * 3000), (None, "http://g", "same"), (None, None, "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string").repartition(3)
    records, ws = archive(spark, pages)
    captures = warc.assemble(records).cache()
    assert records.count() == 3 * len(rows) and captures.count() == len(rows)
    assert captures.where("n_requests = 1 and n_metadata = 1 and request is not null and metadata is not null").count() == len(rows)
    payload = {r[0]: bytes(r[1]).decode() for r in captures.where("response.type = 'response'").select("metadata.page_id", "response.payload").collect()}
    assert payload["7"] == tricky and payload["8"] == "é" * 3000 and payload["4"] == ""
    got = {r["page_id"]: tuple(r)[1:] for r in warc.resolve(captures, ws).where("page_id is not null").collect()}
    assert got[3][2:] == ("response", None) and got[5][2:] == got[9][2:] == ("revisit", 3) and got[6][2:] == ("revisit", 4)
    assert got[5][:2] == got[3][:2] == (4, "".join(__import__("base64").b32encode(hashlib.sha1(b"same").digest()).decode()))
    records, ws = archive(spark, pages, min_bytes=5)
    kinds = Counter(r["type"] for r in records.collect())
    assert kinds["revisit"] == 0 and kinds["response"] == len(rows)
    records, ws = archive(spark, pages.where("false"))
    assert warc.resolve(warc.assemble(records), ws).collect() == []


def test_warc_orphans_and_cut_archives(spark, tmp_path):
    def record(kind, rid, to, block):
        to = f"WARC-Concurrent-To: {to}\r\n" if to else ""
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{to}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    (tmp_path / "a.gz").write_bytes(gzip.compress((record("warcinfo", "i", "", "x") + record("request", "q", "r", "GET") + record("request", "p", "r", "GET") + record("metadata", "m", "gone", "page-id: 8")).encode()))
    whole = record("response", "r", "", "body\n")
    (tmp_path / "b.gz").write_bytes(gzip.compress((whole + record("response", "cut", "", "y" * 500)[:-100]).encode()))
    got = {r["capture_id"]: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"i", "r", "gone"}
    assert got["r"]["request"]["record_id"] == "p" and got["r"]["n_requests"] == 2 and bytes(got["r"]["response"]["payload"]) == b"body\n"
    assert got["gone"]["response"] is None and got["gone"]["metadata"]["page_id"] == "8"


def test_urls(spark):
    cases = {
        1: ("http://x.NET/a", "x.net", "/a", "net/", "block"), 2: ("https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        3: ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), 4: ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
        5: ("http://xexample.com/de/", "xexample.com", "/de/", None, None), 6: ("http://a.net", "a.net", "", None, None), 7: (None, "", "", None, None), 8: ("a.net/x", "", "", None, None),
        9: ("http://ÄB.net?x://y", "Äb.net", "", None, None), 10: ("http://a.net/b\nc?d", "a.net", "/b\nc", "net/", "block"), 11: ("", "", "", None, None),
    }
    pages = spark.createDataFrame([(k, v[0], "x", "y") for k, v in cases.items()] + [(1, cases[1][0], "x", "y")], "page_id long, url string, label string, path string")
    got = [r for r in urls.judge(pages).collect()]
    assert len(got) == 12
    for r in got:
        want = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == want[1:4] and r["verdict"] == (want[4] or r["verdict"]) and r["verdict"] in urls.LABELS
    assert urls.judge(pages.where("false")).collect() == []


def all_rules(rows, support, confidence):
    """(tokens, label) to (confidence, support), by every combination of tokens."""
    want = {}
    names = sorted({t for ts, _ in rows for t in ts})
    for size in range(1, len(names) + 1):
        for combo in itertools.combinations(names, size):
            has = [label for t, label in rows if set(combo) <= set(t)]
            for label in urls.LABELS:
                n = has.count(label)
                if has and n >= math.ceil(support * len(rows) - 1e-9) and n / len(has) >= confidence:
                    want[combo, label] = (n / len(has), n / len(rows))
    return {k: c for k, c in want.items() if not any(set(q) < set(k[0]) and label == k[1] and d[0] >= c[0] for (q, label), d in want.items())}


def test_mined_rules(spark):
    rng = random.Random(2)
    for together in ([], ["x", "y"]):  # tokens that always come along with a, and one that is always blocked
        rows = [(sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randrange(1, 5))), None) for _ in range(200)]
        rows = [(t + together * ("a" in t) + ["p"] * (k % 7 == 0), "block" if k % 7 == 0 or "a" in t and "c" in t or rng.random() < 0.1 else "allow") for k, (t, _) in enumerate(rows)]
        support, confidence = 0.05, 0.75
        want = all_rules(rows, support, confidence)
        df = spark.createDataFrame([*rows, (None, None)], "tokens array<string>, label string")
        rules = urls.mine(df, Workspace(spark, "test"), support, confidence)
        assert not together or ["a", "x", "y"] in [m for r in rules.collect() for m in r["all"]]
        got = {}
        frequency = Counter(t for ts, _ in rows for t in ts)
        for r in rules.collect():
            for combo in itertools.product(*r["all"]):
                got[tuple(sorted(combo)), r["label"]] = (r["confidence"], r["support"])
            assert frequency[r["rarest"]] == min(frequency[t] for t in r["items"]) and r["rarest"] in r["rare"]
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
        assert (("p",), "block") in want and any(len(k[0]) > 1 for k in want)


def url_tokens(url):
    """host, path and tokens, by plain string functions."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    ext = re.search(r"\.([A-Za-z0-9]{1,5})$", path)
    host_ = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    query = rest[len(host) + len(path) :]
    out = {f"h:{x}" for x in host_.split(".")} | {f"p:{x}" for x in path.split("/")} | {f"q:{x}" for x in re.findall("[?&]([^=&#]+)", query)}
    return host_, path, {x for x in out | ({f"x:{ext[1]}"} if ext else set()) if len(x) > 2}


def test_verdicts_of_unruled_urls(spark):
    rng = random.Random(4)
    words_ = ["ads", "news", "shop", "en", "de", "img"]
    pages = []
    for k in range(300):
        host = rng.choice(["a.net", "b.net", "www.example.net", "example.com", "x.example.com", "c.org", "d.info", "e.com"])
        path = "/" + "/".join(["en" if "example.net" in host else "de" if "example.com" in host else "fr" if host == "c.org" and k % 3 else "z", *rng.sample(words_, 2)])
        pages.append((k, f"http://{host}{path}{rng.choice(['', '/', '.html', '.gif'])}{rng.choice(['', '?id=1', '?id=1&ref=2'])}"))
    pages.append((300, None))
    labelled, free = [], {}
    for k, url in pages:
        host, path, has = url_tokens(url)
        fit = [(len(h + p), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            labelled.append((sorted(has), max(fit)[1]))
        else:
            free[k] = has
    best = {}
    weighed = Counter((tuple(t), v) for t, v in labelled)  # every combination of up to three tokens that a url to be judged has
    for k, has in free.items():
        found = []
        for size in range(1, 4):
            for combo in itertools.combinations(sorted(has), size):
                of = Counter()
                for (t, v), n in weighed.items():
                    of[v] += n * (set(combo) <= set(t))
                found += [(combo, v, n / of.total(), n / len(labelled)) for v, n in of.items() if n >= math.ceil(0.01 * len(labelled) - 1e-9) and n / of.total() >= 0.8]
        kept = [x for x in found if not any(set(y[0]) < set(x[0]) and y[1] == x[1] and y[2] >= x[2] for y in found)]
        best[k] = max(((c, s, len(t), v) for t, v, c, s in kept), default=None)
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string").repartition(3)).collect()}
    assert len(got) == len(pages) and len(free) > 30 and len({v and v[3] for v in best.values()}) > 1
    for k in free:
        want = best[k]
        assert got[k]["rule"] is None and got[k]["method"] == ("mined" if want else "default")
        assert got[k]["verdict"] == (want[3] if want else "allow") and (want is None or abs(got[k]["confidence"] - want[0]) < 1e-9)


def test_many_names_that_come_along(spark):
    names = "&".join(f"n{k}={k}" for k in range(40))
    pages = [(k, f"http://{'example.com/de' if k % 2 else 'a.org/fr'}/{k % 5}?{names}") for k in range(200)] + [(200, f"http://b.info/{3}?{names}")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == 201 and got[200]["rule"] is None


def test_mixing(spark, docs, empty, odd_ids):
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "source").collect()}
    size = {d: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for d, r in rows.items()}
    per = defaultdict(int)
    for d, r in rows.items():
        per[r["source"]] += size[d]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = fill(per, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}, 3)
    runs = [sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs.repartition(n), bucket_rows=n * 5).collect()) for n in (2, 2)]
    assert runs[0] == runs[1]
    taken = defaultdict(int)
    for d, n, s, t, k in runs[0]:
        source = rows[d]["source"]
        assert n == size[d] and s == per[source] and abs(t - want[source]) < 1e-6 * max(1, t) and k % max(n, 1) == 0 and k <= 3 * n
        taken[source] += k
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(sorted(size[d] for d, r in rows.items() if r["source"] == s)[-1], 1)
    assert mixing.mix(empty).collect() == [] and mixing.mix(odd_ids).count() == 6
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect())
    same = spark.createDataFrame([(None, "a b c", "s")] * 900 + [(None, "d e", "t")] * 100, "doc_id long, text string, source string")
    few = [sorted(tuple(r) for r in mixing.mix(same.repartition(n), bucket_rows=40).select("size", "source", "taken").collect()) for n in (2, 3)]
    assert few[0] == few[1] and len(few[0]) == 1000
    assert mixing.mixed_rows(docs).columns == docs.columns and max(copies.values()) <= 3


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), max_size=60), st.integers(0, 9))
@settings(max_examples=80, deadline=None)
def test_flight(units, seed):
    p, size = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    out = mixing.flight(p, size, np.random.default_rng(seed))
    inside = (out > 0) & (out < 1)
    assert inside.sum() <= 2 and ((out >= 0) & (out <= 1)).all()
    assert abs(out.sum() - p.sum()) < 1e-5 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    landed = mixing.landing(out, size)
    assert set(landed.tolist()) <= {0.0, 1.0}


def test_buckets_of_rows_without_ids(spark, monkeypatch):
    inner = mixing._flown

    def counted(land, seed):
        run = inner(land, seed)
        return lambda rows: run(rows).assign(whole=len(rows))

    monkeypatch.setattr(mixing, "_flown", counted)  # copies then tell how many rows the last bucket of a row had
    same = spark.createDataFrame([(None, f"x {k % 3}", "s") for k in range(500)] + [(k, "y " * 30, "t") for k in range(9)], "doc_id long, text string, source string")
    assert max(r["copies"] for r in mixing.mix(same, bucket_rows=40, most=9).where("source = 's'").collect()) <= 41


def prouhet(n=1024):
    """Two words of n letters that have one hash under any polynomial modulo 2^64."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, two = prouhet()
    b = next(blocks(pa.array([f"{one} {two} {one.upper()}"])))
    assert b.hashes[0] == b.hashes[2] != b.hashes[1]
    library, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(open(TOKENIZER, encoding="utf-8").read())
    _, ids, ends = next(encoder.encode(pa.array([one, two])))
    assert [ids[: ends[0]].tolist(), ids[ends[0] :].tolist()] == [x.ids for x in library.encode_batch([one, two], add_special_tokens=False)]
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, two)], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.Decontaminator(df, bench).report(df).orderBy("doc_id").collect()] == [False, True]
    assert [r["n_links"] for r in near.similar(df).collect()] == [0, 0]
    assert [r["n_removed"] for r in lines.matches(df).collect()] == [0, 0]


def clashing(buf, starts, ends, seed=0):
    """A hash under which most spans of one size collide."""
    return (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)


def test_bytes_decide_where_hashes_clash(monkeypatch):
    monkeypatch.setattr("basalt.llm.words.span_hashes", clashing)
    monkeypatch.setattr("basalt.llm.tokens.span_hashes", clashing)
    some = ["ab cd ab", "cd ab ef gh ij kl ab", "", "Ab cD", "xy"]
    b = next(blocks(pa.array(some)))
    number, first = numbered(b.low, b.starts, b.ends, b.hashes)
    flat = [w for t in some for w in words(t)]
    assert all((x == y) == (number[i] == number[j]) for i, x in enumerate(flat) for j, y in enumerate(flat))
    codes, at = numbered_shingles(number, b.at, 2)
    sets = [set(codes[at[k] : at[k + 1]].tolist()) for k in range(len(some))]
    grams = [{tuple(words(t)[k : k + 2]) for k in range(max(1, len(words(t)) - 1))} if words(t) else set() for t in some]
    assert all(len(x & y) == len(f & g) for x, f in zip(sets, grams, strict=True) for y, g in zip(sets, grams, strict=True))
    library, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(open(TOKENIZER, encoding="utf-8").read())
    _, ids, ends = next(encoder.encode(pa.array(some)))
    assert [ids[a:e].tolist() for a, e in zip([0, *ends[:-1]], ends, strict=True)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    index = decontaminate.Index(["1"], ["ab"], 10, np.zeros(1 << 20, np.int64), 0)
    start, _ = index.occurrences(b)
    assert start.tolist() == [k for k, w in enumerate(flat) if w == "ab"]
    with pytest.raises(decontaminate.HashClash):
        decontaminate.Index(["1"], ["ab cd"], 10, np.zeros(1 << 20, np.int64), 0)


@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_texts_in_parts(text, chunk):
    column = pa.array(["x", text, "y z"])
    for after in (LINE_FEED, NO_WORD):
        parts = list(blocks(column, chunk=chunk, cut=after))
        assert b"".join(b.buf.tobytes() for b in parts) == f"x{text}y z".encode()
        got = [h for b in parts for h in b.hashes.tolist()]
        assert got == [h for b in blocks(column) for h in b.hashes.tolist()]
        assert all(b.rest == 0 or after[b.buf[-1]] for b in parts)


@given(st.lists(st.sampled_from(["aa", "b", "cc", "\n", "d e f", "'s", "é", ""]), max_size=40))
@settings(max_examples=40, deadline=None)
def test_parts_change_nothing(some):
    text = " ".join(some)
    column, rank = pa.array(["aa b", text, "cc"]), (np.arange(1 << 20) % 4096).astype(np.uint16)

    def all_of():
        lines_ = [(b.lo + r, n, lo, hi) for b, s in lines._sets(column, rank) for r, n, lo, hi in zip(s.row.tolist(), s.number.tolist(), s.lo.tolist(), s.hi.tolist(), strict=True)]
        ends = [(b.lo + k, n) for b, s in lines._sets(column, rank) if not b.rest for k, n in enumerate(s.n_lines.tolist())]
        signed = [(lo + r, m.tolist()) for lo, rows, mins in near._signatures(column) for r, m in zip(rows.tolist(), mins, strict=True)]
        return lines_, ends, signed, quality.statistics(column).tolist()

    whole = all_of()
    with pytest.MonkeyPatch.context() as m:
        m.setattr("basalt.llm.words.blocks.__defaults__", (5, 0, None))
        m.setattr("basalt.llm.quality.CHUNK", 5)
        assert all_of() == whole
    encoder = tokens.Encoder(open(TOKENIZER, encoding="utf-8").read()) if not _encoder else _encoder[0]
    _encoder[:] = [encoder]
    got = [(ids.tolist(), ends.tolist()) for _, ids, ends in encoder.encode(column, 5)]
    assert [x for ids, _ in got for x in ids] == [x for t in column.to_pylist() for x in Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids]


_encoder = []


def test_lines_beyond_2_20(spark):
    df = spark.createDataFrame([(1, "x y z" + "\n" * (1 << 20) + "x y z")], "doc_id long, text string")
    assert [tuple(r) for r in lines.matches(df).collect()] == [(1, (1 << 20) + 1, 1, 0, [1 << 20])]


def test_long_texts_and_words(spark):
    rng = random.Random(8)
    word = "".join(rng.choice("abcdefgh") for _ in range(1 << 20))
    text = " ".join(f"w{rng.randrange(50000)}" for _ in range(900_000))
    df = spark.createDataFrame([(1, word), (2, word + "x"), (3, text), (4, text + " more"), (5, word.upper())], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.similar(df).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (1, 1)}
    assert {r["doc_id"]: r["n_removed"] for r in lines.matches(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    bench = spark.createDataFrame([(1, word), (2, text[-300:])], "item_id long, text string")
    got = {r["doc_id"]: r["n_items"] for r in decontaminate.Decontaminator(df, bench).report(df).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_decontamination(spark, docs, empty, monkeypatch):
    by_id = texts(docs)
    long = max(by_id.values(), key=len).split()
    items = [(1, " ".join(long[50:80]).upper()), (2, " ".join(long[60:70])), (3, "w1 w2"), (4, None), (5, "..."), (6, "one"), (7, " ".join(long[100:109])), (8, " ".join(f"none{k}" for k in range(30))), (12, "one")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, node string")
    want = {d: contamination(t, items) for d, t in by_id.items()}
    assert sum(x[4] for x in want.values()) >= 3 and not all(x[4] for x in want.values())
    for words_at_once in (1 << 18, 5):  # the second cuts the benchmark into blocks
        monkeypatch.setattr("basalt.llm.decontaminate.BLOCK_WORDS", words_at_once)
        d = decontaminate.Decontaminator(docs, bench)
        assert {r[0]: tuple(r)[1:] for r in d.report(docs).collect()} == want
    clean = d.clean(docs)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, x in want.items() if not x[4])
    assert d.report(empty).collect() == []
    none = decontaminate.Decontaminator(docs, bench.where("false"))
    assert none.report(docs).where("contaminated or n_items > 0").count() == 0


def test_statistics_text_by_text(docs):
    some = [*texts(docs).values(), "a\n", "\n", "x" * 70 + "\n" + "x" * 70, None]
    for got, text in zip(quality.statistics(pa.array(some)), some, strict=True):
        raw, w = (text or "").encode(), words(text or "")
        row = dict(zip(quality.FEATURES, got.tolist(), strict=True))
        if not raw:
            assert not got.any()
            continue
        sizes, lines_ = [len(x.encode()) for x in w], raw.split(b"\n")
        grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        want = {
            "share_0": sum(97 <= x < 123 for x in raw) / len(raw), "share_4": raw.count(10) / len(raw), "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(w)),
            "word_bytes": np.mean(sizes or [0]), "word_bytes_sd": np.std(sizes or [0]), "short_words": np.mean([x <= 3 for x in sizes] or [0]), "long_words": np.mean([x >= 12 for x in sizes] or [0]),
            "distinct_words": len(set(w)) / max(len(w), 1), "top_word": max(Counter(w).values(), default=0) / max(len(w), 1), "distinct_shingles": len(set(grams)) / max(len(grams), 1), "log_lines": math.log1p(len(lines_)),
            "line_bytes": np.mean([len(x) for x in lines_]), "distinct_lines": len(set(lines_)) / len(lines_), "short_lines": np.mean([len(x) < 20 for x in lines_]), "bytes_per_word": len(raw) / (len(w) + 1),
        }
        assert all(abs(row[k] - v) <= 1e-5 * max(1, abs(v)) for k, v in want.items()), (text[:50], row, want)


def test_trees_in_arrays():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.train(x[:1500], y[:1500])

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert quality.train(np.zeros((0, 6), np.float32), np.zeros(0)).score(x[:3]).tolist() == [0.5] * 3


def test_quality(spark, docs, empty, odd_ids):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.fit(table, labels)
    got = quality.score(table, trees).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() > 0.95
    held = {d for d in range(1000) if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {r["doc_id"] for r in quality.score(table, trees).where("held_out").collect()} == held
    assert quality.score(docs, trees).where("score between 0 and 1").count() == docs.count()
    assert quality.score(empty, trees).collect() == [] and quality.score(odd_ids, trees).count() == 6
    assert quality.keep(docs, trees, threshold=0.0).columns == docs.columns and quality.keep(docs, trees, threshold=2.0).isEmpty()
    nothing = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    twice = quality.fit(table.union(table), labels)  # repeated rows change nothing
    assert np.array_equal(twice.threshold, trees.threshold) and np.array_equal(twice.value, trees.value)
    again = quality.fit(table, labels.union(labels).withColumn("quality", F.when(F.col("doc_id") % 97 != 0, F.col("quality"))))
    assert quality.score(table, again).where("predicted = 0").count() > 0
