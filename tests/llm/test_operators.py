"""Operators of the llm subpackage against brute force, round trips and edge cases, on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, html_extract, jaccard_join, language_id, matroska, mixture, packing, quality, shingles, url_filter
from tessera.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=("a",), langs=("en",)):
    rows = [(k, x, langs[k % len(langs)], sources[k % len(sources)], len(x or "")) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(df):
    """The same rows with columns whose names clash with those the operators make."""
    return df.withColumns({c: F.lit("clash") for c in ("score", "size", "chunk", "host", "stats")})


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def brute_groups(texts):
    def shingle_set(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())

    sets = [shingle_set(x) for x in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), top(k)) for k, s in enumerate(sets)}


def near_texts():
    base = words(120, 1)
    texts = [None, "", " \t\n", "one", "One two", "one two", "one two three", " ".join(base)]
    r = random.Random(3)
    for k in range(40):
        copy = list(base if k % 2 else words(60, k % 7 + 10))
        for _ in range(r.randrange(5)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(9)}"
        texts.append((" ".join(copy)).upper() if k % 5 == 0 else " ".join(copy))
    return texts + texts[-3:] + [" ".join(words(30_000, 99, 10**6))]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_join_is_brute_force(spark, block):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(odd(documents(spark, texts)), block=block).collect()}
    assert got == brute_groups(texts)


def test_jaccard_join_of_repeated_rows_and_of_none(spark):
    docs = documents(spark, near_texts()[:12])
    out = jaccard_join.join(docs.union(docs))
    assert out.count() == 24 and out.distinct().count() == 12
    assert jaccard_join.join(docs.limit(0)).count() == 0
    nameless = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    assert [tuple(r) for r in jaccard_join.join(docs.union(nameless)).where("doc_id IS NULL").collect()] == [(None, None, None)] * 2
    kept = jaccard_join.stage(spark, docs.union(docs), "")
    assert kept.columns == docs.columns and kept.count() == len({v[1] for v in brute_groups(near_texts()[:12]).values()})


def forest(links):
    """Each linked node's least partner over any way."""
    links, root = list(links), {}
    for pair in links:
        for x in pair:
            root.setdefault(x, x)
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {k: x if r == y else r for k, r in root.items()}
    return root


def test_trie_finds_what_pairs_find():
    r = random.Random(5)
    for _ in range(60):
        base = r.sample(range(60), 25)
        sets = [np.array(sorted({*r.sample(base, r.randrange(15, 25)), *r.sample(range(60), r.randrange(4))}), np.uint64) for _ in range(12)]
        links = jaccard_join.linked(list(range(12)), [0] * 12, [len(s) for s in sets], sets, 85, 100)
        found = forest(links)
        want = forest((a, b) for a, b in itertools.combinations(range(12), 2) if 185 * len(np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b])))
        assert found == want


def test_shingles_ignore_batching():
    texts = ["a b c d e", "", "x", "Ü b\tc D e"]
    raw = [x.encode() for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, d = shingles.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), ends)
    for k, x in enumerate(raw):
        own, _ = shingles.shingle_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert sorted(own) == sorted(h[d == k])


def test_url_rules_and_reputation(spark):
    urls = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/2"), (3, "https://a.b.net/es/3#f"), (4, "x://b.org"), (5, "no scheme"), (6, None), (7, "http://good.org/aa/7"), (8, "http://bad.org/aa/8"), (9, "http://bad.org/aa/9"), (9, "http://bad.org/aa/9")]
    pages = url_filter.parts(spark.createDataFrame(urls, "page_id long, url string"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = url_filter.judge(pages, url_filter.outcomes_of(pages, labels)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in out[:6]] == [("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/2", "example.com/en/"), ("a.b.net", "/es/3", "net/es/"), ("b.org", "", None), ("", "", None), ("", "", None)]
    assert [r.verdict for r in out[:3]] == ["allow", "block", "block"] and len(out) == 10
    bound = {r.host: r.bound for r in out}
    assert bound["good.org"] > bound["bad.org"] and all(0 <= r.bound <= 1 or r.bound < 1 for r in out)
    assert url_filter.judge(pages.limit(0), url_filter.outcomes_of(pages.limit(0), labels)).count() == 0


def test_registered_domains(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.b.com": ("b.com", "com"), "b.org:8080": ("b.org", "org"), "me@shop.com.au.": ("shop.com.au", "com.au"), "www.foo.de": ("foo.de", "de"),
        "1.2.3.4": ("1.2.3.4", "address"), "[::1]:80": ("[::1]:80", "address"), "localhost": ("localhost", "localhost"), "": ("", ""), "com.example": ("com.example", "example"),
    }
    rows = spark.createDataFrame([(x,) for x in want], "host string").selectExpr("host", f"{url_filter.SUFFIX} AS suffix").selectExpr("host", f"{url_filter.DOMAIN} AS domain", "suffix")
    assert {r.host: (r.domain, r.suffix) for r in rows.collect()} == want


def test_html_blocks():
    page = '<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="cookie-notice">eat</div><article><h1>T &amp; U</h1><p>a <b>b</b>c<p>d\n e<div class="ad">buy</div><aside>no</aside></article><section id="comments"><article>me</article></section><footer>f</footer>'
    kept = [t for k, t in html_extract.blocks(page) if k == html_extract.TEXT]
    assert kept == ["T & U", "a bc", "d e"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p") == [] and html_extract.blocks("<!-- x") == []


def plain_texts(pages, window, gap, least):
    """Texts of (id, host, html) by loops over tokens, windows and sets of pages."""
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    word = lambda w: int(shingles.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])

    def hashed(ws):
        h = np.array([word(ws[0])], np.uint64)
        for w in ws[1:]:
            h = shingles.mix(h * shingles.C + np.array([word(w)], np.uint64))
        return int(h[0])

    seen, kept = {}, []
    for ident, host, html in pages:
        found = html_extract.blocks(html)
        words, begins, stops = [], [], []
        for _, t in found:
            begins.append(len(words))
            words += [low(w) for w in t.split(" ")]
            stops.append(len(words))
        n = len(words) - window + 1
        hashes = [hashed(words[k : k + window]) for k in range(max(0, n))]
        at = {k for k in begins + [s - window for s in stops] if 0 <= k < n}
        at |= {min(range(k, k + gap), key=lambda i: hashes[i]) for k in range(n - gap + 1)}
        kept.append((found, words, at))
        for k in at:
            seen.setdefault((host, tuple(words[k : k + window])), set()).add(ident)
    out = {}
    for (ident, host, _), (found, words, at) in zip(pages, kept):
        marks = np.zeros(len(words), bool)
        for k in at:
            if len(seen[host, tuple(words[k : k + window])]) >= least:
                marks[k : k + window] = True
        out[ident] = html_extract.page_text(found, marks, window)
    return out


def test_html_repeats_are_those_of_whole_hosts(spark):
    r = random.Random(1)
    notice = [" ".join(words(n, n)) for n in (9, 14, 30, 5)]
    pages = []
    for k in range(60):
        own = [" ".join(words(r.randrange(3, 40), 1000 + k * 9 + j)) for j in range(4)]
        body = own + r.sample(notice, 2) + [own[0] + " " + notice[2] + " " + own[1]]
        r.shuffle(body)
        head = "<article>" if k % 10 == 0 else ""
        pages.append((k, f"h{k % 2}.org", head + "".join(f"<p>{x}</p>" for x in body)))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, h, x in pages], "page_id long, url string, html string")
    want = plain_texts(pages, 8, html_extract.GAP, 3)
    assert any(notice[2] not in want[k] for k in range(60) if k % 10)
    for settings in ({}, {"most_pages": 4}, {"chunk": 300}):
        assert {x.page_id: x.text for x in html_extract.extract(df.repartition(3), **settings).collect()} == want


def test_html_extract(spark):
    menu = "<div>home news sport weather travel money food shop more</div>"
    pages = [(k, "http://h.org/%d" % k, f"{menu}<div>story number {k} is about {'x' * k} things</div>") for k in range(5)] + [(9, None, None), (10, "http://h.org/10", "<main>only this</main>" + menu)]
    pages += [(11, "http://two.org/a", menu), (12, "http://two.org/b", menu), (13, "http://two.org/c", "<div>" + " ".join(words(200_000, 3)) + "</div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(odd(df.union(df).union(df))).collect()}
    assert got[9] == "" and got[10] == "only this" and got[3] == "story number 3 is about xxx things"
    assert got[11] == "home news sport weather travel money food shop more"  # on two pages alone, however often their rows are repeated
    assert len(got[13].split()) == 200_000
    assert html_extract.extract(df.union(df)).count() == 20 and html_extract.extract(df.limit(0)).count() == 0


def test_html_names_beside_other_words_are_text_of_an_article():
    """Names that only look like boilerplate within an article are kept; outside of one, and alone, they are boilerplate."""
    names = ("section class='related-work'", "p class='comment-on-policy'", "div id='social-contract'", "div class='widget-theory'", "div class='share-price'")
    inside = "".join(f"<{x}>kept {k}</{x.split()[0]}>" for k, x in enumerate(names))
    junk = "".join(f"<div class='{x}'>gone</div>" for x in ("ad", "ad-slot-3", "related-posts", "comment-list", "social-links", "widget_area", "share-buttons"))
    page = f"<body><div class='related-work'>gone</div><article>{junk}<p>first</p>{inside}</article></body>"
    assert html_extract.page_text(html_extract.blocks(page), np.zeros(99, bool)) == "\n".join(["first", *(f"kept {k}" for k in range(len(names)))])
    # A reader's comment marked up as an article is none; an article about comments is.
    two = "<article class='comment'>gone</article><article class='comment-on-policy'><p>kept</p></article>"
    assert html_extract.page_text(html_extract.blocks(two), np.zeros(9, bool)) == "kept"


def test_html_names():
    page = '<article class="post"><div class="article-header"><h1>Real title</h1></div><p class="share-price">12.50</p><div class="share-buttons">tweet</div><div class="search-results">found</div><section class="comment-list">me</section><div class="notice">mind</div></article>'
    found = html_extract.blocks(page)
    assert html_extract.page_text(found, np.zeros(99, bool)) == "Real title\n12.50\nfound"
    assert html_extract.page_text(found, np.ones(99, bool)) == ""
    bare = '<div class="sidebar">s</div><div id="main-content"><p>kept</p><div class="ad">a</div></div><div>other</div>'
    assert html_extract.page_text(html_extract.blocks(bare), np.zeros(9, bool)) == "kept"


def test_packing_places_every_piece(spark):
    texts = [None, "", "hello world", "hello world", "a  b\n\nc"] + [" ".join(words(n, n)) for n in (5, 300, 900, 40, 7000)]
    out = packing.pack(odd(documents(spark, texts)), packing.tokenizer_path()).collect()
    tokenizer = packing.encoder(packing.tokenizer_path()).tokenizer
    for k, x in enumerate(texts):
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        parts = sorted((r for r in out if r.doc_id == k), key=lambda r: r.piece)
        assert [zlib.crc32(ids[r.start : r.start + r.length]) for r in parts] == [r.ids_crc32 for r in parts] and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 1024 for r in parts[1:])
    for _, rows in itertools.groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(documents(spark, texts).limit(0), packing.tokenizer_path()).count() == 0


def test_sum_of_squares_is_plain_search():
    """Each piece against every open bin, by the sum itself."""
    r = random.Random(4)
    for room in (10, 32):
        sizes = sorted((r.randrange(1, room + 1) for _ in range(150)), reverse=True)
        open_: list = []
        want = []
        for size in sizes:
            gaps = sorted({room - sum(x) for x in open_ if sum(x) < room and room - sum(x) >= size})
            if not gaps:
                open_.append([])
                best = room
            else:
                def total(g):
                    after = [room - sum(x) for x in open_]
                    after[after.index(g)] -= size
                    return sum(after.count(v) ** 2 for v in set(after) if 0 < v < room)

                best = min(gaps, key=lambda g: (total(g), g))
            k = max(i for i, x in enumerate(open_) if room - sum(x) == best) if best == room else next(i for i, x in enumerate(open_) if room - sum(x) == best)
            want.append(room - best)
            open_[k].append(size)
        bins, offsets = packing.sum_of_squares(np.array(sizes), room)
        assert offsets.tolist() == want and len(set(bins.tolist())) == len(open_)


def test_sum_of_squares_wastes_little():
    sizes = np.sort(np.random.default_rng(0).integers(1, 700, 3000))[::-1]
    bins, offsets = packing.sum_of_squares(sizes)
    used = np.bincount(bins, sizes)
    assert used.max() <= 1024 and len(used) <= 1.03 * sizes.sum() / 1024 + 1
    assert (np.bincount(bins, offsets == 0) == 1).all()


def test_mixture_targets_and_epochs(spark):
    docs = documents(spark, [" ".join(words(5 + k % 9, k)) for k in range(300)] + [None, ""], sources=("a", "a", "a", "b", "c", None))
    sized = docs.select("doc_id", "source", mixture.size_of().alias("size")).withColumn("_key", mixture.key_of(F.lit(1.0)))
    out = mixture.mix(sized, cell_rows=16).collect()
    total = sum(r.size for r in out)
    per: dict = {}
    for r in out:
        s = per.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert sum(s[1] for s in per.values()) == pytest.approx(total)
    for taken, target, size in per.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-9
    again = {r.doc_id: r.taken for r in mixture.mix(sized.repartition(3), cell_rows=999).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    assert mixture.mix(sized.limit(0)).count() == 0
    whole = mixture.stage(spark, odd(docs), "")
    assert set(docs.columns) <= set(whole.columns) and whole.count() > 0


def test_mixture_takes_equal_rows_one_by_one(spark):
    for copies in (1, 20):
        rows = [(1, "a", 10)] * copies + [(k, "a", 7) for k in range(2, 7)] + [(100 + k, "b", 30) for k in range(20)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("_key", mixture.key_of(F.lit(1.0)))
        for shuffled in (docs, docs.repartition(5)):
            out = mixture.mix(shuffled, cell_rows=4).collect()
            for source in "ab":
                mine = [r for r in out if r.source == source]
                assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(0 <= r.taken <= 3 * r.size for r in mine)
        assert sorted(map(tuple, mixture.mix(docs).collect())) == sorted(map(tuple, mixture.mix(docs.repartition(3)).collect()))
    texts = ["ab cd ef gh"] * 20 + ["ij kl"]
    named = documents(spark, texts, sources=("a", "b")).withColumns({"doc_id": F.lit(7).cast("long"), "size": F.lit("own"), "_row": F.lit(1)})
    kept = mixture.stage(spark, named, "")
    assert kept.columns == named.columns and kept.count() > 0 and {r["size"] for r in kept.collect()} == {"own"}


def test_language_trees(spark):
    r = random.Random(2)
    syllables = {"aa": ["ka", "ri", "mo"], "bb": ["sch", "ung", "ei"]}
    texts = [" ".join("".join(r.choices(syllables["aa" if k % 2 == 0 else "bb"], k=3)) for _ in range(30)) for k in range(80)] + [None, "", "123 !?", "ü"]
    docs = documents(spark, texts, langs=("aa", "bb"))
    trees = language_id.fit(odd(docs))
    out = {x.doc_id: x for x in language_id.predicted(odd(docs), trees).collect()}
    assert all(out[k].lang_pred == ("aa" if k % 2 == 0 else "bb") for k in range(80))
    assert [out[k].lang_pred for k in (80, 81, 82)] == ["und"] * 3 and out[83].lang_pred in ("aa", "bb") and all(0 <= x.score <= 1 for x in out.values())
    contexts = np.unique(np.concatenate([trees.codes[0][::97] >> 8, [0, 1 << 20]]))
    every = (contexts[:, None] << 8 | np.arange(256)).ravel()
    for tree in trees.trees():
        assert np.allclose(np.exp2(-tree.bits(every)).reshape(-1, 256).sum(1), 1)  # code lengths are those of a distribution in every context
    assert language_id.predicted(docs.union(docs), trees).distinct().count() == 84
    none = language_id.fit(docs.limit(0))
    assert {x.lang_pred for x in language_id.predicted(docs, none).collect()} == {"und"}


def plain_ppm(taught, text):
    """Code length of a text by walking contexts byte by byte, with escapes of method C and exclusions."""
    def low(x):
        return [c + 32 if 65 <= c <= 90 else c for c in x.encode()]

    seen: dict = {}
    for x in taught:
        raw = [language_id.PAD] * language_id.ORDER + low(x)
        for i in range(language_id.ORDER, len(raw)):
            for k in range(language_id.ORDER + 1):
                after = seen.setdefault(tuple(raw[i - k : i]), {})
                after[raw[i]] = after.get(raw[i], 0) + 1
    raw, bits = [language_id.PAD] * language_id.ORDER + low(text), 0.0
    for i in range(language_id.ORDER, len(raw)):
        out: set = set()
        for k in range(language_id.ORDER, -1, -1):
            if tuple(raw[i - k : i]) not in seen:
                continue
            after = {s: n for s, n in seen[tuple(raw[i - k : i])].items() if s not in out}
            if not after:
                continue
            whole = sum(after.values()) + (0 if len(after) + len(out) == 256 else len(after))
            if raw[i] in after:
                bits += np.log2(whole / after[raw[i]])
                break
            bits += np.log2(whole / len(after))
            out |= set(after)
        else:
            bits += np.log2(256 - len(out))
    return bits


def test_code_lengths_are_those_of_plain_ppm(spark):
    taught = {"xx": ["abracadabra Abra", "banana bandana", ""], "yy": ["Ünter über", "zebra"]}
    rows = [(k * 4, x, lang) for k, (lang, x) in enumerate((lang, x) for lang, some in taught.items() for x in some)]
    rows = [(next(i for i in range(50 * k, 50 * k + 50) if zlib.crc32(str(i).encode()) % 4 != 2), x, lang) for k, (_, x, lang) in enumerate(rows)]
    trees = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["abra cadabra", "über", "", "Zebra banana ¿qué?", "a" * 40]
    raw = [x.encode() for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for _ in range(2):  # from the trees, then from the table
        got = trees.sums(np.frombuffer(b"".join(raw), np.uint8), ends)
        for k, lang in enumerate(sorted(taught)):
            assert [got[i, k] for i in range(len(texts))] == pytest.approx([plain_ppm(taught[lang], x) for x in texts], abs=0.01)
    codes = np.concatenate([c for c, _ in language_id.windows(np.frombuffer(b"".join(raw), np.uint8), ends)])
    small = [c for c, _ in language_id.windows(np.frombuffer(b"".join(raw), np.uint8), ends, 3)]
    assert (np.concatenate(small) == codes).all()


def test_quality(spark):
    good = [" ".join(words(60, k, 5000)) + "." for k in range(150)]
    bad = [" ".join(["spam"] * 50) if k % 2 else "!!! " * 40 for k in range(60)]
    docs = documents(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(210)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.features(odd(docs))
    model = quality.fit(stats, labels)
    out = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    assert sum((out[k] >= 0.5) == (k < 150) for k in range(210)) > 205 and all(0 <= s <= 1 for s in out.values()) and len(out) == 212
    empty = quality.fit(stats.limit(0), labels.limit(0))
    assert {r.score for r in quality.scored(stats, empty).collect()} == {0.5}
    kept = quality.kept(odd(docs), model)
    assert kept.columns == odd(docs).columns and {r.doc_id for r in kept.collect()} == {k for k, s in out.items() if s >= quality.CUT}


def test_statistics_are_those_of_plain_counting():
    texts = ["", "Hello hello WORLD. 12!", "a b c d a b c d a b c d\nx\n\ny  z\té#", "x" * 40, " \n", " ".join(words(400, 2, 30))]
    raw = [x.encode() for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), ends)
    for k, x in enumerate(raw):
        n = max(len(x), 1)
        count = {name: sum(bool(row[c]) for c in x) for name, row in quality._classes.items()}
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.lower())
        grams = [tuple(w[i : i + 4]) for i in range(len(w) - 3)] or ([tuple(w)] if w else [])
        often = max((w.count(y) for y in set(w)), default=0)
        shares = [x.count(bytes([c])) / n for c in range(256)]
        want = [
            np.log1p(len(x)), np.log1p(len(w)), sum(map(len, w)) / len(w) if w else 0, count["upper"] / max(count["upper"] + count["lower"] + count["high"], 1e-9 * n), count["upper"] / n, count["digit"] / n,
            count["space"] / n, count["stop"] / n, count["loud"] / n, count["symbol"] / n, count["high"] / n, np.log1p(count["line"]), count["period"] / max(len(w), 1), -sum(s * np.log2(s) for s in shares if s),
            len(set(w)) / len(w) ** 0.8 if w else 0, often / max(len(w), 1), sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1), 1 - len(set(grams)) / len(grams) if w else 0,
        ]
        assert got[k] == pytest.approx(want), k
    long = np.frombuffer((" ".join(words(400_000, 9)) + "x" * 1_500_000).encode(), np.uint8)
    assert quality.statistics(long, np.array([0, len(long)]))[0, 0] == pytest.approx(np.log1p(len(long)))


def test_fit_is_plain_ridge_and_pooling(spark):
    """Features, normal equations and calibration by loops over the same rows."""
    docs = documents(spark, [" ".join(words(20 + k % 30, k, 40 if k % 3 else 4000)) for k in range(240)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0) if k % 11 else k % 2, 0) for k in range(240)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    stats = quality.features(docs)
    model = quality.fit(stats, labels)
    x = {r.doc_id: np.frombuffer(r.stats) for r in stats.collect()}
    y = {k: float(int(k % 3 == 0) if k % 11 else k % 2) for k in range(240)}
    fold = {k: zlib.crc32(str(k).encode()) % 4 for k in range(240)}
    taught = [k for k in range(240) if fold[k] != 2]
    table = np.array([x[k] for k in taught])
    mean, spread = table.mean(0), table.std(0) + 1e-6
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / quality.WIDTH, (quality.STATS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def lift(k):
        z = np.clip((x[k] - mean) / spread, -8, 8)
        return np.array([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w[:, j] + b[j]) for j in range(quality.FEATURES)] + [1.0])

    fitted = [k for k in taught if fold[k] != 3]
    z = np.array([lift(k) for k in fitted])
    ridge = np.eye(z.shape[1]) * quality.RIDGE * len(fitted)
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ np.array([y[k] for k in fitted]))
    assert np.allclose(model.beta, beta, atol=1e-6)
    bins: dict = {}
    for k in taught:
        if fold[k] == 3:
            at = min(max(int((lift(k) @ beta + 0.5) / 2 * quality.BINS), 0), quality.BINS - 1)
            bins.setdefault(at, []).append(y[k])
    at = sorted(bins)
    # Isotonic means by the least maximum over all stretches.
    sums, n = [sum(bins[a]) for a in at], [len(bins[a]) for a in at]
    means = [max(min(sum(sums[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    knots, values = quality.pooled((np.array(at, float) + 0.5) / quality.BINS * 2 - 0.5, np.array(sums), np.array(n, float))
    assert np.allclose(model.knots, knots) and np.allclose(model.values, values) and len(knots) == len(set(np.round(means, 12)))
    assert quality.fit(stats.union(stats), labels.union(labels)).knots.size  # repeated rows


def test_isotonic_is_monotone():
    at, good, count = np.arange(9) / 9, np.array([0, 3, 1, 2, 2, 5, 4, 6, 6]), np.full(9, 6)
    _, values = quality.pooled(at, good, count)
    assert (np.diff(values) >= 0).all()


def test_matroska_round_trip_and_broken_files():
    for n in (64, 1024, 4096, 4096 * 3 + 64, 70_000 - 70_000 % 64):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        data = matroska.mux(payload)
        found, facts = matroska.packets(data)
        assert matroska.read_samples(data) == payload and facts["error"] is None and facts["clusters"] == len(facts["cues"])
        assert b"".join(data[p["offset"] : p["offset"] + p["length"]] for p in found) == payload
        assert matroska.packets(data[: len(data) // 2])[1]["error"]
    for kind in (matroska.XIPH, matroska.FIXED, matroska.EBML_LACING):
        frames = [bytes([k]) * (300 if kind == matroska.FIXED else 1 + 300 * k) for k in range(4)]
        data = matroska.laced(frames, kind)
        assert [data[a : a + n] for a, n in matroska.frame_ranges(data, 0, len(data), kind)] == frames
    unknown = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + (matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.unsigned(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x01\x80ab")) * 2
    assert [(p["timestamp"], p["cluster"], p["length"]) for p in matroska.packets(unknown)[0]] == [(8, 1, 2), (8, 2, 2)]
    assert matroska.packets(b"")[0] == [] and matroska.packets(b"\x00junk")[1]["error"]


def test_matroska_digests(spark):
    texts = [None, "", "é" * 40, "x" * 64, "x" * 64]
    docs = odd(documents(spark, texts))
    out = matroska.digests(matroska.stored(docs)).orderBy("doc_id").collect()
    for r, x in zip(out, texts):
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[3][1:] == out[4][1:]
    assert matroska.packet_table(matroska.stored(docs)).groupBy("doc_id").count().count() == 5
    assert matroska.digests(matroska.stored(docs.limit(0))).count() == 0


def test_fingerprints_are_homomorphic():
    a, b, c = "one two", "three four five", "six"
    whole = fingerprints.of_text("\n".join([a, b, c]))
    part = fingerprints.Fingerprint([c, a])
    part.add([b])
    assert part.text() == whole.text() == fingerprints.of_text("\n".join([c, b, a])).text()
    part.remove([b])
    assert part.text() == fingerprints.of_text(f"{a}\n{c}").text() and part.likeness(whole) < 1
    text, after = "\n".join(" ".join(words(12, k)) for k in range(30)), "\n".join(" ".join(words(12, 100 + k)) for k in range(30))
    changed = fingerprints.edit(text, after)
    own = fingerprints.of_text(text)
    assert fingerprints.of_edit(own, text, changed).text() == fingerprints.of_text(changed).text()
    assert own.likeness(fingerprints.of_text(changed)) > 0.55 > 0.4 > own.likeness(fingerprints.of_text(after))
    assert fingerprints.of_text("").likeness(fingerprints.of_text(None)) == 1.0 and own.likeness(fingerprints.of_text("")) == 0.0


def test_likeness_is_that_of_plain_counting():
    text = "one two three one two three\nfour\n" + "aaaa" * 9
    want = np.zeros(fingerprints.SKETCH, np.int64)
    for p in fingerprints.paragraphs(text):
        raw, seen = p.encode() + bytes(fingerprints.GRAM - 1), {}
        for k in range(len(p.encode())):
            h = 0
            for byte in raw[k : k + fingerprints.GRAM]:
                h = (h * int(shingles.P) + byte + 1) % 2**64
            again = seen[h] = seen.get(h, -1) + 1
            h = int(shingles.mix(np.array([(int(shingles.mix(np.array([h], np.uint64))[0]) + again * int(shingles.A)) % 2**64], np.uint64))[0])
            want[h >> 56] += 1 - 2 * (h & 1)
    assert (fingerprints.signs(fingerprints.paragraphs(text)) == want).all()


def test_likeness_of_long_and_repeated_texts():
    line = "the same line again and again"
    a, b = fingerprints.of_text("\n".join([line] * 30_000)), fingerprints.of_text("\n".join([line] * 40_000))
    assert a.likeness(b) > 0.999 and a.text() != b.text()
    r = random.Random(8)
    for text in (" ".join(words(300_000, 4, 10**5)), "".join(r.choices("漢字仮名交文章", k=400)), "x" * 300, "".join(r.choices("abcdef", k=200)), " ".join(words(60, 5)) + "\n" + " ".join(words(60, 6))):
        other = " ".join(words(len(text) // 4, 7))
        own = fingerprints.of_text(text)
        near = own.likeness(fingerprints.of_edit(own, text, fingerprints.edit(text, other)))
        assert near > 0.4 and near > own.likeness(fingerprints.of_text(other))


def test_edited_documents_stay_near(spark):
    """Every document of 200 characters or more is nearer to its edited text than to the next text, unless that is a copy."""
    out = fingerprints.query(spark, "/root/testdata/sf0.001").where("n_chars >= 200").collect()
    assert len(out) > 100 and all(r.near_edited >= 0.4 and (r.near_edited > r.near_next or r.near_next > 0.7) for r in out)


def test_edits_are_those_of_the_sorted_table(spark):
    texts = [" ".join(words(k % 13, k)) for k in range(60)] + [None, "", "é😀x" * 9]
    out = {r.doc_id: r for r in fingerprints.edited(odd(documents(spark, texts)).repartition(5), range_rows=7).collect()}
    for k, x in enumerate(texts):
        x, y = x or "", texts[(k + 1) % len(texts)] or ""
        changed = fingerprints.edit(x, y)
        r = out[k]
        assert (r.n_chars, r.edited_sha256, r.edited_fingerprint) == (len(x), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.of_text(changed).text())
        assert r.near_next == fingerprints.of_text(x).likeness(fingerprints.of_text(y))
    docs = documents(spark, texts[:3])
    assert fingerprints.edited(docs.union(docs)).count() == 6 and fingerprints.edited(docs.limit(0)).count() == 0
    assert fingerprints.fingerprints(docs).count() == 3


def test_held_out_share(spark):
    assert [bool(r[0]) for r in spark.range(6).select(held_out("id")).collect()] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(6)]
