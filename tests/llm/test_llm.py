"""The training-data operators against brute-force versions, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, fingerprints, html_extract, language_id, mixing, near_dedup, packing, suffix_dedup, token_files, tokens, topk_search
from graphloom.llm.components import components, joined

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, d int, _part int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3) for r in rows], DOCS)


ODD = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "x y", "fr", None), (4, "  \t ", "fr", "t"), (5, "ß " * 3000, "de", "t")]


@pytest.fixture(params=["odd", "empty"])
def odd(request, spark):
    rows = ODD if request.param == "odd" else []
    return docs(spark, rows), len(rows)


def test_every_operator_on_odd_tables(spark, odd):
    import public_tokenizers as P

    df, n = odd
    assert mixing.mix(df).count() == n
    assert token_files.read_token_files(token_files.write_token_files(df, P.path("byte_bpe_50k.json"))).count() == n
    assert near_dedup.near_duplicates(df).count() == n
    assert packing.pack(packing.pieces_of(df, P.path("word_bpe_49k.json"))).count() >= n
    assert fingerprints.fingerprint_edits(df).count() == n
    assert suffix_dedup.dedup(df).count() == n
    out = language_id.predict(df, language_id.train(df))
    assert out.count() == n and out.filter("text is null and lang_pred <> 'und'").count() == 0
    assert chat_format.rotate(df.limit(0).selectExpr("doc_id conv_id", "doc_id turn", "lang role", "text")).count() == 0
    assert html_extract.extract(df.selectExpr("doc_id page_id", "source url", "text html")).count() == n


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    df = docs(spark, [(i, "w " * rng.randint(1, 60), "en", rng.choice(["a", "b", "c", None])) for i in range(1200)])
    rows = mixing.mix(df).collect()
    assert rows == mixing.mix(df).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
    taken, target = Counter(), {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 30 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6


def test_pareto_inclusion_follows_weights(spark):
    df = docs(spark, [(i, "w", "en", "a") for i in range(4000)]).withColumn("w", F.col("doc_id") % 2 + F.lit(0.5))
    got = {r[0]: r[1] for r in mixing.mix(df, weights=(1,), share_percent=40, weight_column="w").groupBy(F.col("id") % 2).agg(F.avg("copies")).collect()}
    assert got[0] == pytest.approx(0.2, abs=0.04) and got[1] == pytest.approx(0.6, abs=0.04)


def test_longer_documents_are_likelier(spark):
    rng = random.Random(21)
    sizes = {i: rng.choice([1, 10, 100, 1000]) for i in range(4000)}
    df = docs(spark, [(i, "w " * n, "en", "a") for i, n in sizes.items()] + [(9000, None, "en", "a"), (9001, "", "en", "a")])
    copies = {r["id"]: r["copies"] for r in mixing.mix(df, weights=(1,), share_percent=60).collect()}
    total = sum(sizes.values())
    rate = 0.6 * total / sum(n * len(f"{n:b}") for n in sizes.values())
    for n in (1, 10, 100, 1000):
        own = [copies[i] for i, size in sizes.items() if size == n]
        assert np.mean(own) == pytest.approx(rate * len(f"{n:b}"), abs=0.05)
    assert copies[9000] == copies[9001] == 0
    # Where the target is twice the size, everything is taken twice.
    assert {r["copies"] for r in mixing.mix(df.filter("doc_id < 9000"), weights=(1,), share_percent=200).collect()} == {2}


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 1000):
        for top in (1, n, 100 * n, 1 << 30):
            values = np.sort(rng.integers(0, top, n))
            ef = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
            assert values.tolist() == [ef.select(i) for i in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = ["a", "Bc", "é", "ß", "ſ", "İ", "ŉ", " ", " ", "\n", "\t", " ", "'s", "12", "..", ",", "***", "!!?", "$$", "&'d", "ÀÉ", "ªº", "ǅ", "×", "<|endoftext|>", "中", "😀", "é", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(9000)]
    enc, plain = tokens.Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
    assert len(plain.encode("a<|endoftext|>", add_special_tokens=False).ids) == 2


def test_token_file_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = [(i * 3, f"text {i}\nnumber  {i}" * (i % 7), "en", "s") for i in range(300)]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(token_files.write_token_files(docs(spark, rows).repartition(5), P.path("byte_bpe_50k.json"))).collect()}
    t, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for d, text, *_ in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_perspectives_with_nulls(spark):
    c = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, None, "system", "s"), (1, 1, "bob", None), (None, 3, "ann", "x"), (2, 0, " ", "y")], "conv_id long, turn long, role string, text string")
    rows = chat_format.rotate(c).collect()
    for conv, who in {(r["conv_id"], r["perspective"]) for r in rows}:
        own = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["length"] == len(r["segment"])
            at += r["length"]
            masked = r["segment"][r["mask_start"] - r["start"] :][: r["mask_length"]]
            assert (masked != "") == (r["speaker"] == who)
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "ann"), (1, "bob"), (None, "ann"), (2, "unknown")}


def test_lcs_is_longest():
    rng = random.Random(3)
    for _ in range(600):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = html_extract.lcs_pairs(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_page_text(spark):
    page = "<title>t</title><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>x <b>y</b><p>z<div class='comments'>no</div></article><footer>f</footer><script>var a='</p>';"
    plain = "<div>Site name</div><p>Own text {}</p><p>Bottom</p>"
    rows = [(1, "http://h/a/1", page), (2, "http://g/a/1", plain.format(1)), (3, "http://g/a/2", plain.format(2)), (4, None, None)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\nx y\nz", 2: "Own text 1", 3: "Own text 2", 4: ""}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>text <span class=ad>Buy</span>more</p></article>", "text more"),
        ("<article>x<br><a class='share'>Share</a><button>Subscribe</button>y</article>", "x\ny"),
        ("<article>a <span class=ad><div>Buy</div></span> b</article>", "a\nb"),
        ("<article><div class='notice-board'>Real</div><div class='cookie-banner x'>No</div><div id='ad-slot-3'>No</div></article>", "Real"),
        ("<article><p title='it's'>One</p><p title=\"a>b\" x=y>Two</p><p a='>Three</article>", "One\nTwo\nThree"),
        ("<article><p>1 &lt; 2 &amp;amp; 3</p>\n<p>\t</p><ul><li>a<li>b</ul></article>", "1 < 2 &amp; 3\na\nb"),
        ("<main><header>Head</header><h1>T</h1><!-- c --><p>b<script>var x='</p>'</script></main>tail", "Head\nT\nb"),
    ],
)
def test_lines_of_a_page(page, text):
    assert html_extract.main_text(*html_extract.lines_of(page), set()) == text


def test_differencing_against_brute_force(spark):
    """Pairing, alignment and deletion on pages with and without an article element, copies, nulls and repeated rows."""
    rng = random.Random(31)
    rows, own = [], {}
    for i in range(260):
        host = rng.choice(["a.org", "b.org", "c.org", "alone.org"]) if i else "one.org"
        path = "/" + "/".join(rng.choice(["x", "y", "zz"]) for _ in range(rng.randint(1, 3))) + f"/{rng.randint(0, 60)}"
        template = [f"{host} line {k}" for k in range(8) if rng.random() < 0.7]
        body = [f"own {i} {k}" for k in range(rng.randint(0, 4))]
        cut = rng.randint(0, len(template))
        kind = rng.choice(["plain", "plain", "article", "empty", "copy"])
        if kind == "copy" and rows:
            own[i] = (host, path, *own[rng.choice(list(own))][2:])
        elif kind == "empty":
            own[i] = (host, path, [], [])
        else:
            own[i] = (host, path, [*template[:cut], *body, *template[cut:]], body if kind == "article" else None)
        _, _, lines, article = own[i]
        html = "".join(f"<div>{x}</div>" for x in lines) if article is None else "".join(["<nav>menu</nav>", *(f"<p>{x}</p>" for x in lines if x not in article), "<article>", *(f"<p>{x}</p>" for x in article), "</article>"])
        rows.append((i, f"http://{host}{path}", html))
    rows += [(900, None, "<p>x</p>"), (901, None, None), (0, rows[0][1], rows[0][2])]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    pages = {i: (h, p, *html_extract.lines_of(rows[i][2])) for i, (h, p, *_) in own.items()}
    order = sorted(pages, key=lambda i: (*pages[i][:2], f"{i:020}"))
    for at, i in enumerate(order):
        host, path, lines, kinds = pages[i]
        best = None
        for side in (reversed(order[:at]), order[at + 1 :]):
            j = next((j for j in side if pages[j][2] != lines), None)
            if j is not None and pages[j][0] == host:
                n = next((k for k, (x, y) in enumerate(zip(pages[j][1], path, strict=False)) if x != y), min(len(path), len(pages[j][1])))
                if best is None or n > best[0]:
                    best = (n, j)
        other = pages[best[1]][2] if best else []
        table = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
        for a, x in enumerate(lines):
            for b, y in enumerate(other):
                table[a + 1][b + 1] = table[a][b] + 1 if x == y else max(table[a][b + 1], table[a + 1][b])
        a, b, shared = len(lines), len(other), set()
        while a and b:
            if lines[a - 1] == other[b - 1]:
                a, b = a - 1, b - 1
                shared.add(a)
            elif table[a - 1][b] >= table[a][b - 1]:
                a -= 1
            else:
                b -= 1
        want = [x for k, x in enumerate(lines) if (kinds[k] == 2 if 2 in kinds else kinds[k] and k not in shared)]
        assert got[i] == "\n".join(want), (i, host)
    assert got[900] == "x" and got[901] == ""


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))] for _ in range(60)]
    rows = []
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "s"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    shingles = {d: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t, *_ in rows}
    parent = {d: d for d in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in shingles:
        for b in range(a + 1, 300):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                assert got[a] == got[b]
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len(set(got.values())) >= 0.95 * len({find(d) for d in parent})


def test_near_duplicates_against_weighted_brute_force(spark):
    """Links are the pairs whose weighted similarity, with exact document frequencies, reaches 0.8."""
    rng = random.Random(14)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(30, 90))] for _ in range(12)]
    common = [f"c{i}" for i in range(20)]
    rows = [(0, " ".join(common), "en", "s"), (1, "Word " * 4 + "x", "en", "s"), (2, "word WORD word word\tx", "en", "s")]
    for i in range(3, 400):
        words = list(rng.choice(base)) + (common if rng.random() < 0.7 else []) + ["again and again we say it"] * rng.choice([0, 0, 4])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "s"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows), prior=0).collect()}
    shingles, seen = {}, Counter()
    for d, t, *_ in rows:
        words = t.lower().split()
        shingles[d] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
        seen.update(set(shingles[d]))
    idf = {x: near_dedup.IDF_FLOOR + (1 - near_dedup.IDF_FLOOR) * min(1, math.log(len(rows) / n) / math.log(near_dedup.RARE)) for x, n in seen.items()}
    total = {d: sum(n * idf[x] for x, n in c.items()) for d, c in shingles.items()}
    sure, likely = {}, {}
    found = links = 0
    for parents in (sure, likely):
        parents.update((d, d) for d in shingles)

    def find(parents, x):
        while parents[x] != x:
            x = parents[x]
        return x

    for a in shingles:
        for b in range(a + 1, len(rows)):
            least = sum(min(n, shingles[b][x]) * idf[x] for x, n in shingles[a].items() if x in shingles[b])
            near = least / (total[a] + total[b] - least)
            if near >= 0.805:
                links += 1
                found += got[a] == got[b]
            for parents, least_near in ((sure, 0.805), (likely, 0.795)):
                if near >= least_near:
                    parents[max(find(parents, a), find(parents, b))] = min(find(parents, a), find(parents, b))
    assert links > 200 and found >= 0.99 * links
    assert all(find(likely, a) == find(likely, c) for a, c in got.items())
    assert len({find(sure, d) for d in sure}) * 1.02 >= len(set(got.values())) >= len({find(likely, d) for d in likely})
    assert got[2] == 1


def test_near_duplicates_inside_hot_buckets(spark):
    """Two loose members of a template group that only share hot buckets, and are no one's centre, are still a class."""
    rng = random.Random(8)
    rows, pairs = [], []
    for group in range(6):
        template = [f"t{group}-{i}" for i in range(160)]
        tails = [10, 10] + [40] * 150
        order = rng.sample(range(len(tails)), len(tails))
        for i, n in enumerate(order):
            rows.append((group * 1000 + i, " ".join(template + [f"u{rng.randint(0, 10**9)}" for _ in range(tails[n])]), "en", "s"))
        pairs.append(sorted(group * 1000 + order.index(n) for n in (0, 1)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    for a, b in pairs:
        assert got[b] == got[a] == a
    assert len(set(got.values())) == len(rows) - len(pairs)


def test_tile_similarities_are_exact():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(1, 60))) for _ in range(60)] + ["a b c d e " * 30, "a b c d e " * 3]
    idf = near_dedup.idf_table(10, rng.integers(0, 10, (near_dedup.SKETCH_ROWS, 1 << near_dedup.SKETCH_BITS)))
    packed = [near_dedup.zstandard.ZstdCompressor().compress(t.encode()) for t in texts]
    tile = near_dedup._Tile(np.arange(len(texts)), np.arange(len(texts)), packed, idf)
    for threshold in (0.1, 0.3, 0.8):
        found = near_dedup._similar(tile, tile, threshold)
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert found[i, j] == (i != j and near_dedup.jaccard(*tile.features(i), *tile.features(j)) >= threshold)


def test_sampler_agrees_as_often_as_similar():
    rng, sampler = np.random.default_rng(5), near_dedup.Sampler()
    agree, near = [], []
    for _ in range(60):
        runs = near_dedup.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        a, b = np.sort(runs[:260]), np.sort(runs[25:285])
        w = np.ones(520, np.float32)
        names = sampler.sample(np.concatenate([a, b]), w, np.array([0, 260, 520]))
        agree.append((names[0] == names[1]).mean())
        near.append(near_dedup.jaccard(a, w[:260], b, w[:260]))
    assert np.mean(agree) == pytest.approx(np.mean(near), abs=0.04)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 60), (60, 70), (70, 50)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(links).collect()} == {i: 1 for i in range(1, 21)} | {50: 50, 60: 50, 70: 50}


def test_components_after_more_links(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(220)]
    pairs = [(a, b) for a, b in pairs if a != b]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = {r["node"]: r["label"] for r in components(table(pairs)).collect()}
    assert {r["node"]: r["label"] for r in joined(components(table(pairs[:120])), table(pairs[120:])).collect()} == whole


def test_packing_is_near_optimal():
    rng = random.Random(6)

    def least(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= capacity:
                    bins[j] += items[i]
                    go(i + 1, bins)
                    bins[j] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        found = packing.pack_histogram(Counter(items), capacity)
        assert Counter(n for p, c in found for n in p * c) == Counter(items) and all(sum(p) <= capacity for p, _ in found)
        assert sum(c for _, c in found) == least(items, capacity) >= packing.lower_bound(Counter(items), capacity)


def test_fillings_fullest_first():
    """Every undominated filling comes, the fullest first, however many small pieces it takes."""
    assert next(packing.fillings({1: 3000}, 2000, 1990)) == (1,) * 2000
    rng = random.Random(9)
    for _ in range(100):
        hist = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room, least = 20, rng.randint(0, 20)
        every = {()}
        for n, c in hist.items():
            every = {(*f, *(n,) * k) for f in every for k in range(c + 1) if sum(f) + n * k <= room}
        found = list(packing.fillings(hist, room, least))
        assert len(found) == len([f for f in every if sum(f) >= least])
        kept = [f for f in found if f is not None]
        assert [sum(f) for f in kept] == sorted((sum(f) for f in kept), reverse=True)
        if found:
            assert found[0] is not None and sum(found[0]) == max(sum(f) for f in every)


def test_packing_of_many_lengths_reaches_the_bound():
    rng = random.Random(5)
    hist = Counter(rng.randint(200, 2200) for _ in range(6000))
    found = packing.pack_histogram(hist)
    assert Counter({n: sum(p.count(n) * c for p, c in found) for n in hist}) == hist and all(sum(p) <= 4096 for p, _ in found)
    assert sum(c for _, c in found) == packing.lower_bound(hist, 4096)


def test_packing_search_keeps_little_per_node():
    """A deep search over many lengths holds neither a histogram nor sums for each of its nodes."""
    rng = random.Random(5)
    hist = Counter(rng.randint(200, 2200) for _ in range(6000))
    tracemalloc.start()
    try:
        found = packing.pack_histogram(hist, most_nodes=600)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert Counter({n: sum(p.count(n) * c for p, c in found) for n in hist}) == hist and all(sum(p) <= 4096 for p, _ in found)
    assert peak < 32 << 20


def test_packed_pieces(spark):
    import public_tokenizers as P

    rows = [(i, "word " * (i * 37 % 5000), "en", "s") for i in range(60)]
    found = packing.pack(packing.pieces_of(docs(spark, rows).repartition(3), P.path("word_bpe_49k.json"))).toPandas().sort_values(["sequence_id", "offset"])
    assert (found.offset == found.groupby("sequence_id").length.cumsum() - found.length).all()
    assert found.groupby("sequence_id").length.sum().max() <= 4096
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 4096) + 1


def test_fingerprints_are_homomorphic():
    one = lambda t: fingerprints.to_string(*(x[0] for x in fingerprints.vectors([t])))
    assert one("a b c\nd e f") == one("d e f\na b c") != one("a b c\na b c")
    assert fingerprints.combine(one("a b c\nd e f"), deleted=one("d e f")) == one("a b c")
    assert fingerprints.combine(one("a b c"), added=one("d e f")) == one("a b c\nd e f")
    texts = [" ".join(f"w{i}" for i in range(k, k + 300)) for k in (0, 0, 150, 5000)]
    _, sketch = fingerprints.vectors(texts)
    assert fingerprints.likeness(sketch[:1], sketch[1:2])[0] == 1
    assert fingerprints.likeness(sketch[:1], sketch[2:3])[0] == pytest.approx(0.5, abs=0.2)
    assert fingerprints.likeness(sketch[:1], sketch[3:])[0] < 0.25


def test_fingerprints_of_structured_and_very_long_texts():
    """Thue-Morse strings and their complements defeat polynomial hashes modulo powers of two."""
    for n in (1024, 2048, 4096, 8192):
        text = "".join("ab"[i.bit_count() & 1] for i in range(n))
        lanes, _ = fingerprints.vectors([text, text.translate({97: 98, 98: 97})])
        assert (lanes[0] != lanes[1]).all()
    _, sketch = fingerprints.vectors(["a " * 70_000, "a " * 35_000])
    assert np.abs(sketch[0]).sum() == 69_998 and fingerprints.likeness(sketch[:1], sketch[1:])[0] == pytest.approx(1)


def test_fingerprint_rows(spark):
    rows = [(i, f"line {i}\n" * (i % 5) + "é" * (i % 3), "en", "s") for i in range(50)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, rows).repartition(4)).collect()}
    for i, text, *_ in rows:
        changed = fingerprints.edited(text, rows[(i + 1) % 50][1])
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(text)


def brute_dedup(rows):
    seen, out = set(), Counter()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    while rows:
        same = [r for r in rows if r[0] == rows[0][0]]
        rows = rows[len(same) :]
        new = set()
        for d, t in same:
            data = (t or "").encode()
            gone = bytearray(len(data))
            for s in range(len(data) - 49):
                if data[s : s + 50] in seen:
                    gone[s : s + 50] = b"\1" * 50
                new.add(data[s : s + 50])
            runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
            out[d, len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
        seen |= new
    return out


@pytest.mark.parametrize("piece", [1 << 20, 130])
def test_passages_against_brute_force(spark, monkeypatch, piece):
    rng = random.Random(piece)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(30, 300))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice([rng.choice(base), "x" * rng.randint(0, 90), rng.choice(base)[10:80], "\0" * rng.randint(0, 60), "yz" * 40]) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i, i - 1, None]), "".join(parts) if rng.random() < 0.95 else None))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_dedup(rows)
    data = "".join(base).encode()
    for chunk, ends, _, places in suffix_dedup.pieces(np.frombuffer(data, np.uint8), np.array([0, len(data)]), piece):
        for a, b, place in zip(ends, ends[1:], places, strict=False):
            assert chunk[a:b].tobytes() == data[place : place + b - a]


def test_workers_take_little_memory():
    """Peaks of what Python and numpy hold: 29, 22 and 80 MB as measured; before, 66, 71 and 174 MB."""

    def peak(make) -> float:
        tracemalloc.start()
        try:
            made = make()  # noqa: F841 (held while the peak is read)
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(3)
    texts = pa.array([bytes(rng.integers(97, 123, 6000, np.uint8)).decode() for _ in range(500)])
    ids = pa.array(range(500), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["d", "rk", "text"])
    every = SimpleNamespace(value=np.full(suffix_dedup.ANCHOR_BITS // 8, 255, np.uint8))
    cuts = SimpleNamespace(value=[b"m" * suffix_dedup.GRAM])
    assert peak(near_dedup.Sampler) < 35
    assert peak(lambda: list(suffix_dedup._send_anchors(8, 200)([batch]))) < 40
    assert peak(lambda: list(suffix_dedup._send_contexts(every, cuts, 8, 2)([batch]))) < 110


def test_multikey_sort():
    words = np.random.default_rng(7).integers(0, 3, (500, 5)).astype(np.uint64)
    assert (words[suffix_dedup.multikey_sort(words)] == words[np.lexsort(words.T[::-1])]).all()


def test_language_model_codes_are_exact():
    model = language_id.Model({"x": ["abracadabra abab"], "y": ["zyzzy zy zyx"]}, order=2)
    for text in ("abra", "zyz a", "qqé"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(data, np.array([0, len(data)]))[0]
        for k, lang in enumerate(model.langs):
            tree, context, bits = model.trees[lang], [0, 0], 0.0
            for s in model.symbol[data].tolist():
                costs = tree.bits(context)
                assert np.exp2(-costs).sum() <= 1 + 1e-9
                bits += costs[s]
                context = [context[1], s]
            assert got[k] == pytest.approx(bits, rel=1e-4)


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op9_ppm_language(spark, "/root/testdata/sf0.01").filter("held_out").join(df.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang_pred = lang").count() >= 0.98 * out.count()


def test_long_texts_train_a_language(spark):
    import corpus_pipeline as cp

    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, " ".join(word("abcd") for _ in range(50)), "aa", "s") for i in range(20)] + [(100 + i, " ".join(word("wxyz") for _ in range(3000)), "ww", "s") for i in range(20)]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, language_id.train(df)).collect()}
    assert got == {d: lang for d, _, lang, _ in rows}
    assert all(len(t.encode()) <= 4096 for t in language_id.sample(df)["ww"])
    none = docs(spark, [(1, "some words", None, "s"), (2, None, None, "s"), (3, "12 34", None, "s")])
    assert [r["doc_id"] for r in cp.identify_language(spark, none, "").collect()] == [1]


def test_top_k_with_ties_nulls_and_wide_values(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 64]) for i in range(80)] + [(80, None), (81, [1.0, None]), (82, [float("nan")] * 6), (83, [30.5, -7.25, 0.1, 0.0, 2.0, 1.0]), (7, [0.0] * 6), (84, []), (100, [1.0, 1.0]), (101, [3e5, 0.0]), (120, [3e38, -2e38]), (121, [3e38, 1.0]), (122, [2.9e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(topk_search.usable(df), F.col("vec_id") % 20 == 0, k=10, block_rows=17, block_queries=2).collect()
    own = [(i, [math.floor(64 * Fraction(float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, (qid, v) in enumerate(own):
        if qid % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for j, (i, w) in enumerate(own) if j != q)[:10]
            want = [(max(-(2**63) + 1, min(2**63, s)), i) for s, i in want]
            assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])] == want


def test_rows_that_share_an_id(spark):
    """Different texts under one id are different documents; only near copies go."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, d), (4, d + " more"), (None, a), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in cp.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted([(0, a), (1, a), (1, b), (2, c), (3, d), (5, ""), (5, "")])


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    one, shared = text(80), text(30)
    rows = [(1, one, "en", "a"), (2, one, "en", "b"), (3, None, "en", "a"), (4, "123 456", "en", "a"), (5, f"{text(40)} {shared} {text(40)}", "en", "a"), (6, f"{text(40)} {shared} {text(40)}", "en", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(cp.STAGES)
    a = stages["language"](spark, df, "")
    assert sorted(r["doc_id"] for r in a.collect()) == [1, 2, 5, 6]
    b = stages["near_duplicates"](spark, a, "")
    assert sorted(r["doc_id"] for r in b.collect()) == [1, 5, 6]
    c = {r["doc_id"]: r for r in stages["repeated_passages"](spark, b, "").collect()}
    assert shared in c[5]["text"] and shared not in c[6]["text"] and c[6]["n_chars"] == len(c[6]["text"])
    d = stages["mix"](spark, b, "")
    assert d.columns == df.columns and d.count() >= 3
    assert stages["pack"](spark, d, "").count() == d.count()


CLASH = "_id long, _copy int, _h int, lang_pred string, score double, kept string, n_bytes long, id long, size int, copies int, label long, row long, packed string, _own0 string, `a b.c` int"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables_with_clashing_names(spark, empty):
    """Null ids, texts and sources, empty and very long texts, ties, repeated rows; other columns come through unchanged."""
    import corpus_pipeline as cp

    rng = random.Random(40)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30_000))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id"), (2, "one two three four five six"), (3, None), (None, None), (None, "no id here"), (None, "no id here"), (4, ""), (5, ""), (6, " \t "), (7, long), (8, long + " end"), (9, "12 34")]
    rest = (77, 5, 6, "xx", 0.25, "k", 8, 9, 10, 11, 12, 13, "p", "o", 14)
    rows = [(d, t, "en", None if i % 3 else "s", len(t or ""), *rest) for i, (d, t) in enumerate(texts)]
    df = spark.createDataFrame([] if empty else rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, df, ""), f"test-{name}")
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        assert all(tuple(r)[5:] == rest for r in out.collect())
        seen[name], df = Counter((r["doc_id"], (r["text"] or "")[:30]) for r in out.collect()), out
    packed = cp.STAGES[-1][1](spark, df, "").collect()
    assert len(packed) >= sum(seen["mix"].values())
    if empty:
        assert not packed and not any(seen.values())
        return
    start = lambda t: t[:30]
    language = Counter((d, start(t)) for d, t in texts if t and any(c.isalpha() for c in t))
    assert seen["language"] == language
    near = Counter({(1, start(texts[0][1])): 1, (1, start(texts[2][1])): 1, (None, "no id here"): 2, (7, start(long)): 1})
    assert seen["near_duplicates"] == near == seen["repeated_passages"]
    assert set(seen["mix"]) <= set(near) and max(seen["mix"].values()) <= 4


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over a small table: what each decision leaves, recomputed plainly."""
    import corpus_pipeline as cp

    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(20, 200))] for _ in range(60)]
    shared = " ".join(word() for _ in range(25))
    rows = []
    for i in range(240):
        words = list(rng.choice(base))
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"edit{i}"
        text = " ".join(words) if rng.random() < 0.85 else f"{' '.join(word() for _ in range(60))} {shared} {' '.join(word() for _ in range(60))}"
        rows.append((i, rng.choice([text] * 30 + [None, "", "1 2 3"]), rng.choice(["aa", "bb"]), rng.choice(["x", "y", "z"])))
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    shingles = {r[0]: Counter(tuple(r[1].split()[k : k + 5]) for k in range(max(1, len(r[1].split()) - 4))) for r in kept}
    parent = {r[0]: r[0] for r in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (least := sum((shingles[a] & shingles[b]).values())) >= 0.8 * sum((shingles[a] | shingles[b]).values()) and least:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = [r for r in kept if find(r[0]) == r[0]]
    seen, left = set(), {}
    for d, t, _, s in kept:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(data) - 49):
            if data[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= {data[k : k + 50] for k in range(len(data) - 49)}
        left[d] = (bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore"), s)
    sizes, words = Counter(), {d: len(t.split()) for d, (t, _) in left.items()}
    for d, (_, s) in left.items():
        sizes[s] += words[d]
    copies = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    total, weight, target, open_ = 1.5 * sum(sizes.values()), {"x": 5, "y": 2, "z": 1}, {}, set(sizes)
    while open_:
        rate = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(rate * weight[s], 2 * sizes[s])
        open_ -= over or open_
    for s in sizes:
        taken = sum(n * words[d] for d, n in copies.items() if left[d][1] == s)
        assert abs(taken - target[s]) <= max(words.values())
    import public_tokenizers as P
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode
    for r in got:
        ids = [*encode(left[r["doc_id"]][0], add_special_tokens=False).ids, 1][r["start"] : r["start"] + 4096]
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 1
