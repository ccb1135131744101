"""Operators against brute force, on a table of hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, mixing, near_dup, packing, pii, quality, repeats, token_files, url_filter, warc
from tidewater.llm.common import components
from tidewater.llm.rolling import shingles

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, base string, node int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeèü") for _ in range(rng.randint(2, 7))) for _ in range(n))


def hard_rows():
    rng = random.Random(7)
    passage = sentence(rng, 60)
    texts = [None, "", " \t\n", "one", "a b c", "x" * 5000, "ab " * 3000, passage, passage + " tail", "head " + passage, sentence(rng, 20000)]
    for _ in range(6):
        base = sentence(rng, 120).split(" ")
        edited = base.copy()
        edited[60] = "edited"
        texts += [" ".join(base), " ".join(edited), "  ".join(base), " ".join(base[:60]) + "\n" + " ".join(base[60:]), sentence(rng, 40) + " " + passage + " " + sentence(rng, 40)]
    texts += ["line one two\nline one two\nother\n\n", "mail a.b@c.example.com, +1 (555) 123-45678, 10.0.0.255 and 10.0.0.256, 4111 1111 1111 1111 \U0001f600 x@y.zz"]
    texts += ["Karlotta schrieb " + sentence(rng, 6) + f" Quentinsson karl.q@mail.example.com {w}" for w in ("eins", "zwei", "drei", "vier", "fünf")]
    texts += ["weird\x0bspace\x85here\xa0<|endoftext|> tail", "tabs\t\tand\r\nlines  end "]
    out = [(i, t, "en", ["src0", "src0", "src1", None, "src2"][i % 5], len(t or ""), -i, "clash", 1) for i, t in enumerate(texts)]
    return out + [out[7], out[7], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def got(df):
    return [r.asDict() for r in df.collect()]


def key(x):
    return (x is not None, x or 0)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def holds(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(x) <= 255 for x in text.split("."))
    if kind == 2:
        s = sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)])
        return 14 <= len(d) <= 19 and s % 10 == 0
    return kind == 0 or 10 <= len(d) <= 15


def spans_of(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m.group()))


def printed(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)


def test_pii(docs, empty):
    found = got(pii.sanitise(docs, with_text=True))
    want = Counter()
    for r in hard_rows():
        s = spans_of(r[1] or "")
        want[(r[0], *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(printed(s).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == want
    for r in found:
        kinds = [x for x in r["spans"].split(",") if x and not x.startswith("term")]
        assert hashlib.sha256(",".join(kinds).encode()).hexdigest() == r["base_sha256"]
        assert not re.search(PATTERNS[0], r["clean_text"])
    # the name that stands only beside one address, in different surroundings, discloses it
    named = [r for r in found if "[EMAIL]" in r["clean_text"] and "schrieb" in r["clean_text"] + "schrieb" and r["n_terms"]]
    assert len(named) == 5 and all("Quentinsson" not in r["clean_text"] for r in named)
    assert not any(r["n_terms"] for r in found if r["n_email"] == 0)
    assert got(pii.sanitise(empty)) == []


def test_pii_rare_terms(spark, tmp_path):
    """Two different surroundings are enough for a term that stands nowhere else; copies of one are not, nor is a common term."""
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(("und", "der", "mit", "das")) for _ in range(n))
    texts = [f"{filler(30)} {w}" for w in ("Bericht", "Vertrag") for _ in range(150)]
    texts += [f"Morgenrot Bericht {w} an r.m@mail.example.com" for w in ("Herbst", "Winter")]
    texts += ["Abendrot Vertrag an a.b@mail.example.com"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    found = {r["doc_id"]: r for r in got(pii.sanitise(spark.read.parquet(str(tmp_path / "t")), with_text=True))}
    assert [found[i]["clean_text"] for i in (300, 301)] == ["M* Bericht Herbst an [EMAIL]", "M* Bericht Winter an [EMAIL]"]
    assert all(found[i]["n_terms"] == 0 for i in (302, 303, 304))


def test_pii_far_terms(spark, tmp_path):
    """A name discloses an address wherever it stands in the documents, near or far, before or beyond other entities; copies with an edit here and there are one document."""
    rng = random.Random(41)
    texts = [sentence(rng, 60) for _ in range(300)]
    for i in range(6):
        texts.append(f"Quentinsson {sentence(rng, 60)} k.q@mail.example.com, o{i}@x{i}.example.org {sentence(rng, 60)} sagte Quentinsson {sentence(rng, 3)}")
    base = f"Lindqvist {sentence(rng, 80)} a.b@mail.example.com {sentence(rng, 80)}".split(" ")
    for i in (10, 25, 40, 55, 120, 140):
        edited = base.copy()
        edited[i] = "edited"
        texts.append(" ".join(edited))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    found = {r["doc_id"]: r for r in got(pii.sanitise(spark.read.parquet(str(tmp_path / "t")), with_text=True))}
    for i in range(300, 306):
        places = [f"term:{m.start()}:{m.end()}" for m in re.finditer("Quentinsson", texts[i])]
        assert len(places) == 2 and set(places) <= set(found[i]["spans"].split(","))
        assert "Quentinsson" not in found[i]["clean_text"] and "[EMAIL], [EMAIL]" in found[i]["clean_text"]
    assert all(f"term:0:{len('Lindqvist')}" not in found[i]["spans"] and found[i]["n_terms"] == 0 for i in range(306, 312))


def test_pii_scan(spark):
    """Sums and maxima of what stands before, over arrays of any length."""
    for n in (0, 1, 127, 128, 129, 1000):
        v = [(7 * i) % 31 for i in range(n)]
        r = spark.createDataFrame([(v,)], "v array<int>").select(pii._scan(F.col("v"), pii._plus).alias("a"), pii._scan(F.col("v"), pii._most).alias("b")).first()
        assert r["a"] == [sum(v[:i]) for i in range(n)] and r["b"] == [max(v[:i], default=0) for i in range(n)]


def test_pii_many_matches(spark, tmp_path):
    """Thousands of matches in one text, overlapping ones too, with all spans where they are and a text cleaned of each."""
    rng = random.Random(31)
    kinds = ["a.b@c.de", "10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111", "+4111 1111 1111 1111", "1.2.3.4@x.org", "\U0001f600"]
    text = " ".join(rng.choice([*kinds, sentence(rng, 3)]) for _ in range(6000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    r = got(pii.sanitise(spark.read.parquet(str(tmp_path / "t")), with_text=True))[0]
    want, clean, at = spans_of(text), "", 0
    assert len(want) > 3000 and r["base_sha256"] == hashlib.sha256(printed(want).encode()).hexdigest()
    assert r["n_terms"] == 0
    for s, k, e in want:
        clean, at = clean + text[at : max(at, s)] + (("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k] if s >= at else ""), max(at, e)
    assert r["clean_text"] == clean + text[at:]


def test_pii_long_runs(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 60000 + " " + "1" * 60000 + " x@y.z" + "@q.w_r@s.t")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    r = got(pii.with_base(spark.read.parquet(str(tmp_path / "t"))))[0]
    assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == spans_of(" " * 120001 + r["text"][120001:])


def brute_repeats(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        runs = repeats.merged([(i, i + n) for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1], len(t))
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def repeats_found(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got(repeats.without_repeats(df)))


def test_repeats(docs, empty, monkeypatch):
    rows = hard_rows()
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows]), strict=True))
    assert repeats_found(docs) == want
    assert got(repeats.without_repeats(empty)) == []
    monkeypatch.setattr(repeats, "CLASS", 1)  # every group by windows
    assert repeats_found(docs) == want


def test_repeat_groups(docs, monkeypatch):
    """Each group is one string with all its places, and the groups cover what is repeated."""
    own = repeats._numbered(docs)
    texts = {r["row"]: bytes(r["data"]) for r in got(own)}
    for limit in (repeats.CLASS, 2):  # by trees, and by windows
        monkeypatch.setattr(repeats, "CLASS", limit)
        by, covered = defaultdict(set), defaultdict(list)
        for r in got(repeats.groups(own.select("row", "data"))):
            by[r["group"]].add((r["row"], r["start"], r["stop"]))
            covered[r["row"]].append((r["start"], r["stop"]))
        for places in by.values():
            strings = {texts[r][a:z] for r, a, z in places}
            string = next(iter(strings))
            assert len(strings) == 1 and len(string) >= 200 and len(places) > 1
            assert len(places) == sum(len(re.findall(b"(?=" + re.escape(string) + b")", t)) for t in texts.values())
        want = brute_repeats(list(texts.values()))
        for (row, t), (_, removed, runs, _) in zip(texts.items(), want, strict=True):
            merged = repeats.merged(covered[row], len(t))
            assert (sum(z - a for a, z in merged), len(merged)) == (removed, runs)


def test_repeats_in_pieces(monkeypatch):
    """A long text scanned in pieces has the anchors that it has as a whole."""
    rng = random.Random(3)
    text = sentence(rng, 3000).encode()
    whole = repeats._anchor_rows([text], [1]).to_pydict()
    monkeypatch.setattr(repeats, "PIECE", 2000)
    cut = repeats._anchor_rows([text], [1]).to_pydict()
    assert set(zip(whole["pos"], whole["h"], whole["c"], strict=True)) == set(zip(cut["pos"], cut["h"], cut["c"], strict=True))


def test_pieces_have_each_anchor_once(monkeypatch):
    text = sentence(random.Random(3), 3000).encode()
    whole = repeats._anchor_rows([text], [1]).to_pydict()
    monkeypatch.setattr(repeats, "PIECE", 2000)
    cut = repeats._anchor_rows([text], [1]).to_pydict()
    assert sorted(zip(whole["pos"], whole["h"], whole["c"], strict=True)) == sorted(zip(cut["pos"], cut["h"], cut["c"], strict=True))


def test_long_texts_without_repeats(spark, tmp_path):
    """Where pieces meet nothing is repeated that isn't in the text."""
    rng = random.Random(5)
    passage = sentence(rng, 80)
    texts = [sentence(rng, 2500), sentence(rng, 900) + passage + sentence(rng, 900) + passage, passage + sentence(rng, 1300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    want = Counter((i, *b) for i, b in enumerate(brute_repeats([t.encode() for t in texts])))
    size = repeats.PIECE

    def small_pieces(batches):
        repeats.PIECE = 2000  # in the worker
        try:
            for batch in batches:
                yield repeats._anchor_rows(batch["data"].to_pylist(), batch["row"].to_pylist())
        finally:
            repeats.PIECE = size

    def anchored(docs):
        return docs.where(F.length("data") >= repeats.LENGTH).mapInArrow(small_pieces, "h long, c long, row long, pos long")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(repeats, "_anchored", anchored)
        assert repeats_found(spark.read.parquet(str(tmp_path / "t"))) == want


def test_interval_tree():
    words = sorted([b"banana", b"anana", b"nana", b"ana", b"na", b"a"])
    lcp = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False)]
    assert {(n, tuple(words[i : j + 1])) for n, i, j in repeats.intervals(lcp) if n} == {(3, (b"ana", b"anana")), (1, (b"a", b"ana", b"anana")), (2, (b"na", b"nana"))}
    groups = {(n, ext, frozenset(m)) for n, ext, m, _ in repeats.maximal_repeats([b"xyAB", b"zzAB", b"xyAB"], [b"hello one", b"hello two", b"hello one more"], 0)}
    assert (6, 2, frozenset({0, 1, 2})) in groups and (9, 4, frozenset({0, 2})) in groups


def page_rows():
    big = "<html>" + "é" * 200 + "</html>"
    return [(3, "http://A.com/x y", big, 1), (1, None, big, 1), (2, "u://b.net/fr/1", "small", 1), (5, "x", "small", 1), (4, "http://c.net:80?q#f", None, 1), (None, "http://d.com/", big, 1), (7, "http://d.com/\r\nX: y", "z" * 100, 1), (7, "http://d.com/", "z" * 100, 1), (9, "noscheme", "", 1)]


def test_warc(spark, tmp_path, monkeypatch):
    spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest int").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    monkeypatch.setattr(warc, "SHARD_BYTES", 700)
    want, first, seen = Counter(), {}, set()
    for p, _, h, _ in page_rows():
        if p is not None:
            first[h] = min(p, first.get(h, p))
    for p, _, h, _ in sorted(page_rows(), key=lambda r: (r[2] or "", key(r[0]))):
        data = (h or "").encode()
        again = len(data) >= 100 and (p != first[h] or (p, h) in seen)
        seen.add((p, h))
        want[(p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    warc.write(pages, one)
    warc.write(pages.repartition(5), two)
    assert Counter(tuple(r.values()) for r in got(warc.read(spark, one))) == want
    names = lambda d: {f.name: f.read_bytes() for f in d.iterdir() if f.name.endswith(".gz")}
    assert names(tmp_path / "one") == names(tmp_path / "two") and len(names(tmp_path / "one")) > 2
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path / "absent"))
    assert got(warc.round_trip(pages.limit(0))) == []


def test_url_rules_and_graph(spark, tmp_path):
    rows = [(1, "http://A.Example.com/en/x?q", None), (2, "https://www.example.com/en/#t", ""), (3, "http://b.net/es/1", None), (4, "http://b.net/", None), (5, None, None), (6, "nothing", None), (7, "http://com", None), (8, "x://example.com:80/en/", None)]
    link = lambda *h: "".join(f"<a class=x href='http://{x}/p'>t</a>" for x in h)
    rows += [(20, "http://farm.org/", link("b.net", "spam.net")), (21, "http://spam.net/fr/", link("farm.org")), (22, "http://good.org/", link("ok.org")), (23, "http://hub.com/", link("good.org", "ok.org"))]
    rows += [(30 + i, f"http://x{i}.org/", "") for i in range(30)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, src int").write.parquet(str(tmp_path / "p"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got(url_filter.url_filter(spark.read.parquet(str(tmp_path / "p"))))}
    assert found[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert found[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert found[3] == ("b.net", "/es/1", "net/es/", "block")
    assert found[5] == ("", "", None, "allow") and found[6] == ("", "", None, "allow")
    assert found[7] == ("com", "", None, "allow")
    assert found[20][2:] == (None, "block")  # links to blocked hosts only
    assert found[22][2:] == (None, "allow")
    assert len(found) == len(rows)


def test_unruled_pages_of_seeds(spark, tmp_path):
    """The graph's verdict holds for seeds' pages that no rule fits; rules stand."""
    link = lambda *h: "".join(f"<a href='http://{x}/p'>t</a>" for x in h)
    rows = [(1, "http://x.net/es/", None), (2, "http://x.net/", link("y.net")), (3, "http://y.net/fr/", link("x.net")), (4, "http://y.net/en/", None), (5, "http://good.com/", link("fine.org")), (6, "http://fine.org/", None)]
    rows += [(10 + i, f"http://x{i}.com/", None) for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in got(url_filter.url_filter(spark.read.parquet(str(tmp_path / "p"))))}
    assert found[1] == ("net/es/", "block") and found[3] == ("net/fr/", "block")
    assert found[2] == (None, "block") and found[4] == (None, "block")
    assert found[5] == ("com/", "allow") and found[6] == (None, "allow")


def test_pagerank_against_dense(spark):
    edges = [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("c", "a", 1), ("d", "c", 5)]
    names = "abcd"
    m = np.zeros((4, 4))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] += w
    m = m / m.sum(axis=0, keepdims=True)
    seed = np.array([1.0, 0, 0, 0])
    x = seed
    for _ in range(300):
        x = 0.85 * m @ x + 0.15 * seed
    x /= x.sum()
    frames = spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame([("a", 2.0)], "host string, mass double")
    scores = {r["host"]: r["score"] for r in got(url_filter.propagate(*frames))}
    assert all(abs(scores.get(n, 0) - v) < 1e-3 for n, v in zip(names, x, strict=True))


def test_places_need_a_table(spark, docs):
    from tidewater.llm.common import place

    place(docs.where("doc_id > 3").select("text"))
    for df in (docs.repartition(2), docs.distinct(), spark.range(3)):
        with pytest.raises(ValueError):
            place(df)


def brute_classes(texts):
    sh = [shingles([t.encode()])[0] for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or len(sh[i]) and near_dup.aligned(sh[i], sh[j]) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dup(docs, empty):
    rows = hard_rows()
    roots = brute_classes([r[1] or "" for r in rows])
    ids = defaultdict(list)
    for r, c in zip(rows, roots, strict=True):
        ids[c].append(r[0])
    least = {c: min(x, key=lambda v: (v is None, v or 0)) for c, x in ids.items()}
    want = Counter((r[0], least[c], len(ids[c])) for r, c in zip(rows, roots, strict=True))
    found = got(near_dup.near_dup(docs))
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(ids)
    assert got(near_dup.near_dup(empty)) == []
    kept = near_dup.stage(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids)


def test_near_dup_in_mixed_buckets(spark, tmp_path):
    """Texts share passages with many that they aren't linked to; chains, too, are found whole."""
    rng = random.Random(11)
    parts = [sentence(rng, 40) for _ in range(6)]
    texts = []
    for _ in range(60):
        texts.append(" ".join([rng.choice(parts), sentence(rng, 30), rng.choice(parts), rng.choice(parts)]))
    for _ in range(15):
        words = rng.choice(texts).split(" ")
        for _ in range(3):  # each a little further from the first
            at = rng.randrange(len(words) - 4)
            words[at : at + 3] = sentence(rng, 3).split(" ")
            texts.append(" ".join(words))
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    found = got(near_dup.near_dup(spark.read.parquet(str(tmp_path / "t"))))
    assert {r["doc_id"]: r["class_id"] for r in found} == dict(enumerate(brute_classes(texts)))


def test_near_dup_among_strangers(spark, tmp_path, monkeypatch):
    """Hundreds of texts share most of a template without being linked; the few linked ones share nearly all their buckets with them."""
    rng = random.Random(17)
    template = sentence(rng, 92)
    texts = [template + " " + sentence(rng, 12) for _ in range(320)]
    for i in range(40):
        texts.append(" ".join([*texts[i].split(" ")[:93], sentence(rng, 11)]))
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    want = dict(enumerate(brute_classes(texts)))
    assert len(set(want.values())) > 250
    # pairs; a block a bucket; blocks of 50, and then by rare shingles
    for few, block in ((10**6, near_dup.BLOCK), (2, near_dup.BLOCK), (2, 50)):
        monkeypatch.setattr(near_dup, "FEW", few)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        found = got(near_dup.near_dup(spark.read.parquet(str(tmp_path / "t"))))
        assert {r["doc_id"]: r["class_id"] for r in found} == want


def test_near_dup_of_one_text(spark, tmp_path, monkeypatch):
    """Hundreds of copies of one text with edits of their own: some pairs are linked, most are a little too far from each other."""
    rng = random.Random(23)
    base = sentence(rng, 90).split(" ")
    texts = []
    for _ in range(300):
        words = base.copy()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    want = dict(enumerate(brute_classes(texts)))
    for block in (near_dup.BLOCK, 40):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        found = got(near_dup.near_dup(spark.read.parquet(str(tmp_path / "t"))))
        assert {r["doc_id"]: r["class_id"] for r in found} == want


def test_forest():
    """A block gives links that join what all its pairs would, and none within a component; of two sides only pairs across."""
    rng = random.Random(29)
    base = sentence(rng, 80).split(" ")
    texts = []
    for _ in range(60):
        words = base.copy()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words).encode())
    found = shingles(texts)
    links = near_dup.forest(list(range(60)), list(range(60)), found, [0] * 60)
    root = list(range(60))
    for a, b, s in links:
        assert s >= 0.8 and root[a] != root[b]
        root = [root[a] if r == root[b] else r for r in root]
    want = brute_classes([t.decode() for t in texts])
    assert [root.index(r) for r in root] == [want.index(r) for r in want]
    side = [i % 2 for i in range(60)]
    assert all(side[a] != side[b] for a, b, _ in near_dup.forest(list(range(60)), list(range(60)), found, side))
    assert near_dup.forest(list(range(60)), want, found, [0] * 60) == []


def test_forest_in_little_memory():
    """A full block whose pairs nearly all share enough takes a bounded amount beside its matrices; its texts are shingled some at a time."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 100).astype(np.uint64)
    found = []
    for _ in range(near_dup.BLOCK):
        found.append(base.copy())
        found[-1][rng.integers(0, 100, 4)] = rng.integers(1, 1 << 62, 4).astype(np.uint64)
    node = list(range(len(found)))
    tracemalloc.start()
    links = near_dup.forest(node, node, found, [0] * len(node))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == len(node) - 1 and peak < 150e6
    texts = ["", "a b c", *(sentence(random.Random(i), 20000) for i in range(4)), " ", "tail"]
    assert all(np.array_equal(a, b) for a, b in zip(near_dup._shingled(texts), shingles([t.encode() for t in texts]), strict=True))


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.aligned(a, a) == 1
    assert near_dup.aligned(a, np.concatenate([a[50:], a[:50]])) == 0  # the same bag in another order
    assert abs(near_dup.aligned(a, a[:90]) - 0.9) < 1e-9
    assert near_dup.aligned(a, a[:79]) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in got(components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {n: find(n) for n in list(root)}


def test_exact_dedup(docs, empty, spark):
    norm = lambda t: re.sub("[\\x20\\x09-\\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in hard_rows():
        groups[norm(r[1])].append(r[0])
    least = {t: min(x, key=lambda v: (v is None, v or 0)) for t, x in groups.items()}
    want = Counter((r[0], least[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in hard_rows())
    found = got(exact_dedup.exact_dedup(docs))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert got(exact_dedup.exact_dedup(empty)) == []
    kept = exact_dedup.stage(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_digest_index_persists(docs, spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    first = exact_dedup.exact_dedup(docs.where("doc_id < 20"), index, "one")
    n = first.where("kept").count()
    index.close()
    assert not spark.catalog.tableExists(index.table)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, buckets=8)
    again = exact_dedup.DigestIndex(spark, path)  # a later session, which need not know the number
    assert again.buckets == 4
    assert again.read().count() == n
    assert len(list((tmp_path / "index").glob("*.parquet"))) <= 4  # a file a bucket
    second = got(exact_dedup.exact_dedup(docs, again, "two"))
    known = {r["text_sha256"] for r in got(first)}
    assert all(not r["kept"] for r in second if r["text_sha256"] in known)
    assert again.read().count() == len({r["text_sha256"] for r in second} | known)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    found = got(packing.packing(docs, WORD))
    want = Counter()
    for r in hard_rows():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(r[0], s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert got(packing.packing(empty, WORD)) == []


def test_pack_balances():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 5000)
    sequence, offset = packing.pack(lengths)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and (2048 - used).sum() < 0.05 * lengths.sum()
    cost = np.bincount(sequence, lengths + lengths.astype(float) ** 2 / 2048)
    other = np.bincount(np.arange(5000) % len(used), lengths + lengths.astype(float) ** 2 / 2048)
    assert cost.std() < other.std()


def brute_targets(sizes):
    w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    left, out, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if left * w[i] / total >= 2 * sizes[i]]
        for i in full or open_:
            out[i] = 2.0 * sizes[i] if full else left * w[i] / total
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def test_mixing(docs, empty):
    found = got(mixing.mixing(docs))
    words = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    size = Counter()
    for r in hard_rows():
        size[r[3]] += words(r[1])
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, brute_targets([size[s] for s in order]), strict=True))
    src = {r[0]: r[3] for r in hard_rows() if r[0] is not None} | {None: None}
    taken = Counter()
    for r in found:
        s = src[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert len(found) == len(hard_rows())
    for s in order:
        assert abs(taken[s] - target[s]) <= max(words(r[1]) for r in hard_rows() if r[3] == s)
    assert sorted(map(str, got(mixing.mixing(docs)))) == sorted(map(str, found))
    assert got(mixing.mixing(empty)) == []
    mix = mixing.stage(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["passes"] for r in found if r["passes"])


def test_targets(spark):
    """Any number of sources in any number of partitions: weights follow the order of code points, null last."""
    rng = random.Random(37)
    for sizes in ([100, 100, 100], [0, 10], [1, 1000, 1000, 1000], [], [0, 0], [rng.randint(0, 2000) ** 2 for _ in range(500)]):
        names = sorted({"".join(rng.choice("aZé\U0001f600z~") for _ in range(9)) for _ in sizes}, key=str.encode)
        names = [*names[1:], None] if len(names) == len(sizes) > 0 else [f"{i:03d}" for i in range(len(sizes))]
        rows = list(zip(names, sizes, strict=True))
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "source string, source_size long").repartition(3)
        found = {r["source"]: r for r in got(mixing.planned(df))}
        for name, size, want in zip(names, sizes, brute_targets(sizes), strict=True):
            r = found[name]
            assert abs(r["target"] - want) < 1e-6 * max(1.0, want) and abs(r["whole"] * size + r["rest"] - want) <= 0.5 + 1e-6
    assert brute_targets([100, 100, 100]) == [200, 250 * 2 / 3, 250 / 3] and brute_targets([0, 10]) == [0, 15]


def test_fit_is_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 60, 5))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    for _ in range(40):  # lengths over half of what is left to fit
        lengths = np.unique(rng.integers(70_000, 300_000, 4))
        counts = rng.integers(1, 3, len(lengths))
        budget = int(rng.integers(66_000, 400_000))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert abs(int((take * lengths).sum()) - budget) <= min(abs(s - budget) for s in sums) + mixing.DP_WORDS
    assert mixing._few(np.array([90, 100, 130]), np.array([1, 1, 1]), 120).tolist() == [0, 0, 1]
    assert mixing._few(np.array([90, 100]), np.array([2, 1]), 175).tolist() == [2, 0]
    take = mixing.fit(np.array([7, 11, 300]), np.array([10**6, 10**6, 10**5]), 12_345_678)
    assert (take * np.array([7, 11, 300])).sum() == 12_345_678


def test_fit_beside_a_long_text():
    """The program's size follows the budget that is left, not the longest text."""
    import tracemalloc

    lengths = np.concatenate([np.arange(1, 3000), [2_000_000, 50_000_000]])
    tracemalloc.start()
    take = mixing.fit(lengths, np.full(len(lengths), 3), 1_234_567)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (take * lengths).sum() == 1_234_567 and peak < 200 << 20


def test_quality(docs, empty):
    want = Counter()
    for r in hard_rows():
        t = r[1] or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    found = got(quality.quality(docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert got(quality.quality(empty)) == []
    assert quality.stage(docs).columns == docs.columns


def test_host_verdicts(spark, monkeypatch):
    rows = [(f"bad{i}", j < 9) for i in range(3) for j in range(10)] + [(f"good{i}", j < 1) for i in range(20) for j in range(10)] + [(None, False)] * 3 + [("once", True)]
    df = spark.createDataFrame(rows, "host string, base_failed boolean")
    for listed in (quality.MAX_LISTED, 0):  # as a list and as a join
        monkeypatch.setattr(quality, "MAX_LISTED", listed)
        kept = Counter((r["host"], r["kept"]) for r in got(quality.judge(df, "host")))
        assert kept["bad0", True] == 0 and kept["good0", True] == 9 and kept[None, True] == 3
    rates = {r["host"]: r["rate"] for r in got(quality.host_rates(df, "host"))}
    assert 0.2 < rates["once"] < 1 and 0.5 < rates["bad0"] < 0.9  # shrunk towards all hosts


def test_token_files(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    found = sorted(got(token_files.round_trip(docs, BYTE, 2)), key=lambda r: r["start"])
    want = Counter()
    for r in hard_rows():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    assert [key(r["doc_id"]) for r in found] == sorted(key(r["doc_id"]) for r in found)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert got(token_files.round_trip(empty, BYTE, 2)) == []


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_encoder(path, kind, monkeypatch):
    """Cut into pre-tokens or not, the ids are the tokenizer's; also when the cache turns over all the time."""
    from tidewater.llm import tokenize

    monkeypatch.setattr(tokenize, "KEPT", 50)
    rng, e = random.Random(6), tokenize.Encoder(path, kind)
    alphabet = [*"abcABC  \n\t'\"!?.,-_0129é×²ªß÷ÀÉŸǅǆÞıİ€<|>s t re ll d m\r", "'s", "'LL", " '", "  ", "\n\n", "Straße", "ﬁ", "\x1c", "<|endoftext|>", "\u0301"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert e(texts) == [e.whole(t) for t in texts]
    assert [tokenize.odd(t) for t in texts] == [bool(tokenize.ODD.search(t)) for t in texts]


def test_codes():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 70000, 5000).astype(np.uint32), np.minimum(rng.geometric(0.01, 3000), 2**31).astype(np.uint32)):
        code = token_files.Code(token_files.encode(ids))
        assert (code.read(0, len(ids)) == ids).all()
        for i in rng.integers(0, max(1, len(ids)), 50) if len(ids) else []:
            assert code[int(i)] == ids[i]
            j = int(rng.integers(i, len(ids) + 1))
            assert (code.read(int(i), j) == ids[i:j]).all()


def test_pipeline(docs, spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    (tmp_path / "sf").mkdir()
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "sf/documents.parquet"))
    out = got(corpus_pipeline.run(spark, str(tmp_path / "sf")))
    assert out and {r["doc_id"] for r in out} <= {r[0] for r in hard_rows()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix", "pack"]
