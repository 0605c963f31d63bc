import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewise.llm import htmltext, langid, secrets
from tests.conftest import SMALL


# ---------------------------------------------------------------- language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op5_kneser_ney(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_models_are_kneser_ney(spark):
    """The probabilities of the symbols after every context sum to 1 less the share of unseen letters."""
    models = langid.LanguageModels({"x": {"\x01\x01\x01a": 3, "\x01\x01ab": 2, "\x01\x01aa": 1, "\x01ab\x02": 2, "\x01aa\x02": 1}})
    low = np.array([ord(c) for c in "abaab"], np.uint32)
    bits = models.word_bits(low, np.array([0, 2]), np.array([2, 5]))
    assert bits.shape == (2, 1) and np.isfinite(bits).all() and bits[0, 0] < bits[1, 0]
    letters = ["a", "b", "\x02", "\x01"]
    total = 0.0
    for c in letters:
        p = models.uniform
        for k in range(1, langid.ORDER + 1):
            context = ("\x01\x01\x01" + c)[-k:-1]
            key = np.array([langid._one_key(context + c)], np.uint64)
            before = np.array([langid._one_key(context)], np.uint64)
            p = float(models.grams[k - 1](key)[0, 0]) + float(models.contexts[k - 1](before)[0, 0]) * p
        total += p
    assert total <= 1.0 + 1e-6 and total > 0.9


class PlainKneserNey:
    """One language's interpolated Kneser-Ney model over dictionaries, by the textbook's recursion."""

    def __init__(self, words, order, letters):
        self.order, self.letters, self.counts = order, letters, {}
        top = {}
        for w in words:
            w = "\x01" * (order - 1) + w + "\x02"
            for i in range(order - 1, len(w)):
                g = w[i - order + 1 : i + 1]
                top[g] = top.get(g, 0) + 1
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            before = {}
            for g in self.counts[k + 1]:
                if not g.endswith("\x01"):
                    before.setdefault(g[1:], set()).add(g[0])
            self.counts[k] = {g: len(x) for g, x in before.items() if not g.endswith("\x01")}

    def discount(self, k):
        n = list(self.counts[k].values())
        ones, twos = n.count(1), n.count(2)
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.letters) + 1)
        after = {g: c for g, c in self.counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return self.p(gram[1:])
        total, d = sum(after.values()), self.discount(k)
        return max(0.0, after.get(gram, 0) - d) / total + d * len(after) / total * self.p(gram[1:])

    def bits(self, words):
        total, n = 0.0, 0
        for w in words:
            w = "\x01" * (self.order - 1) + w + "\x02"
            for i in range(self.order - 1, len(w)):
                total -= math.log2(self.p(w[i - self.order + 1 : i + 1]))
                n += 1
        return total / n


def test_models_and_predictions_as_plain_kneser_ney(spark):
    """Cross-entropies and languages named, for three small corpora and texts with letters, words and contexts that none has."""
    rng = random.Random(21)
    parts = {"aa": ["ba", "na", "lo", "mi"], "bb": ["sch", "ei", "n", "tz", "lo"], "cc": ["o", "u", "ñe", "ba"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    corpus = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate("aa bb cc".split() * 40)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    models = langid.train(docs)
    learnt = [(t, lang) for i, t, lang in corpus if zlib.crc32(str(i).encode()) % 4 < 2]
    words = {lang: [w for t, x in learnt if x == lang for w in t.split()] for lang in parts}
    letters = {c for ws in words.values() for w in ws for c in w} | {"\x01", "\x02"}
    plain = {lang: PlainKneserNey(ws, langid.ORDER, letters) for lang, ws in words.items()}
    tests = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 12)))) for i, lang in enumerate("aa bb cc".split() * 15)]
    tests += [(100, "Bana, LOMI! 3 xyzzy"), (101, "zzz"), (102, "日本"), (103, "ñ")]
    bits, has = models.entropies(pa.array([t for _, t in tests]))
    got = {r.id: r for r in langid.predict(spark.createDataFrame(tests, "doc_id long, text string"), models).collect()}
    for row, (i, t) in enumerate(tests):
        want = {lang: m.bits(re.findall(r"[^\W\d_]+", t.lower())) for lang, m in plain.items()}
        assert has[row] and bits[row].tolist() == pytest.approx([want[lang] for lang in models.langs], rel=1e-4)
        assert want[got[i].lang_pred] == pytest.approx(min(want.values()), rel=1e-4) and got[i].bits == pytest.approx(min(want.values()), rel=1e-4)


def test_hash_array():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    table = langid.HashArray(keys, np.arange(len(keys), dtype=float)[:, None], -1.0)
    assert (table(keys)[:, 0] == np.arange(len(keys))).all() and (table(keys + np.uint64(1)) == -1).all()


def test_language_of_odd_rows(odd, none, docs):
    models = langid.train(docs)
    rows = {r.id: r for r in langid.predict(odd, models).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3)) and rows[5].lang_pred in models.langs and rows[4].lang_pred in models.langs
    assert langid.predict(none, models).count() == 0
    untrained = langid.train(none)
    assert untrained.langs == [] and {r.lang_pred for r in langid.predict(odd, untrained).collect()} == {"und"}


def test_only_learnable_rows_are_read(docs):
    """Other labels on held-out rows change nothing."""
    other = docs.withColumn("lang", F.when(langid.fold("doc_id") == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(other)
    assert a.langs == b.langs and a.temperature == b.temperature and all((x.keys == y.keys).all() for x, y in zip(a.grams, b.grams, strict=True))


# ---------------------------------------------------------------- html

def test_common_lines():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = htmltext.common_lines(a, b)
        rest = iter(b)
        assert len(got) == table[-1][-1] and got == sorted(set(got)) and all(any(a[i] == y for y in rest) for i in got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a <b>b</b>c<br>d&amp;&eacute; &#x41;<p>e", ["a bc d&é A", "e"]),
        ("<nav>x</nav><article><h1>T</h1><p>t <i>u</article><footer>f", ["T", "t u"]),
        ("<main><div class='x comments'><p>c</p></div><p>ok</p><aside>s</aside></main>out", ["ok"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", ["yes"]),
        ("<div hidden>h</div><div style='display: none'>n</div><div role=navigation>r</div><p title='a>b'>q</p>", ["q"]),
        ("<header>top</header><article><header><h1>own</h1></header><p>body</p></article>", ["own", "body"]),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", ["one", "two", "x y"]),
        ("plain &lt;text&gt; <", ["plain <text> <"]), ("", []), ("<p>cut <a href='x", ["cut"]), ("<form><p>f</form><div class='advert'><div>a</div>b</div>c", ["c"]), ("<title>t</title><textarea>z</textarea>w", ["w"]),
    ],
)
def test_blocks(page, want):
    found = htmltext.blocks(page)
    zone = htmltext.ARTICLE if any(z == htmltext.ARTICLE for _, z in found) else htmltext.PLAIN
    assert [t for t, z in found if z == zone] == want


def test_pages_as_plain_reading(spark):
    rows = {r.page_id: r for r in htmltext.op9_page_difference(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_differencing(spark):
    """Without markup that tells, lines shared with the nearest page of the host go; hosts don't mix."""
    page = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    rows = [
        (1, "http://a.org/x/1", page("Site name", "Follow us", "First story", "Imprint")), (2, "http://a.org/x/2?q=1", page("Site name", "Follow us", "Second story", "More of it", "Imprint")),
        (3, "http://a.org/y/1", page("Other section", "Third story", "Imprint")), (4, "http://b.org/x/1", page("Site name", "Alone on its host")), (5, None, None), (6, "http://c.org/", ""),
        (7, "http://d.org/1", "<article><p>copied</p></article>"), (8, "http://d.org/2", "<article><p>copied</p></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("lines", F.lit(0))
    got = {r.id: r.text for r in htmltext.main_text(df).collect()}
    assert got == {1: "First story", 2: "Second story\n\nMore of it", 3: "Other section\n\nThird story", 4: "Site name\n\nAlone on its host", 5: "", 6: "", 7: "copied", 8: "copied"}
    assert htmltext.main_text(df.limit(0)).count() == 0
    assert htmltext.main_text(df.union(df.where("page_id = 2"))).where("id = 2").count() == 2


def nearest(urls, i, side=2):
    """Ids and depths of the pages around ``i`` in the order of its host's paths, nearest first, plainly."""
    split = {k: re.fullmatch(r"[a-z]+://([^/?#]*)([^?#]*).*", u or "") for k, u in urls.items()}
    where = {k: (m[1], m[2]) if m else ("", u or "") for (k, u), m in zip(urls.items(), split.values(), strict=True)}
    order = sorted(where, key=lambda k: (where[k], k))
    at, found = order.index(i), []
    for j in range(max(0, at - side), min(len(order), at + side + 1)):
        if j != at and where[order[j]][0] == where[i][0]:
            mine, other = where[i][1].split("/"), where[order[j]][1].split("/")
            same = [x == y for x, y in zip(mine, other, strict=False)]
            found.append((-(same.index(False) if False in same else max(len(mine), len(other)) if len(mine) == len(other) else len(same)), abs(j - at), j, order[j]))
    return [x[-1] for x in sorted(found)], [-x[0] for x in sorted(found)]


def plain_common(a, b):
    """Places in ``a`` of one longest common subsequence, by the full table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("renamed", [False, True])
def test_differencing_as_plain_reading(spark, renamed):
    """Pairs, copies and deleted lines as by plain pairing and the full table; with article tags, and without."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("url like '%tion%'")
    rng = random.Random(9)
    line = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    template, stories = [line(3) for _ in range(8)], [[line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 5))] for _ in range(12)]
    site = []
    for i in range(40):  # templates that recur with gaps, stories of which some are copies, and a story's line in two
        lines = [t for t in template[:4] if rng.random() < 0.9] + rng.choice(stories) + [t for t in template[4:] if rng.random() < 0.9]
        site.append((10**6 + i, f"http://site.org/{i % 3}/{i % 5}/{i}", "<p>menu</p>" + "<article>" * (i % 4 == 0) + "".join(f"<div>{x}</div>" for x in lines) + "</article>" * (i % 4 == 0)))
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(site, "page_id long, url string, html string").selectExpr(f"cast(page_id as {dict(pages.dtypes)['page_id']}) as page_id", "url", "html"))
    if renamed:
        pages = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    rows = {r.page_id: r for r in pages.collect()}
    urls = {i: r.url for i, r in rows.items()}
    blocks = {i: htmltext.blocks(r.html) for i, r in rows.items()}
    others = {r.id: (r.others, r.depths) for r in htmltext.neighbours(pages, "page_id", "url").collect()}
    gone = {r.id: r.gone for r in htmltext.shared_lines(pages, "page_id", "url", "html").collect()}
    texts = {r.id: r.text for r in htmltext.main_text(pages).collect()}
    assert len(rows) > 80 and sum(map(len, gone.values())) > 100
    for i, found in blocks.items():
        assert others.get(i, ([], [])) == nearest(urls, i)
        lines = [t for t, _ in found]
        longest = max((t for t, z in found if z != htmltext.CHROME), key=len)
        usable = [(d, [t for t, _ in blocks[j]]) for j, d in zip(*others.get(i, ([], [])), strict=True)]
        usable = [(d, theirs) for d, theirs in usable if longest not in theirs]
        want, cut = 0, {lines[k] for k in gone.get(i, [])}
        if usable:
            near = [theirs for d, theirs in usable if d == usable[0][0]]
            some = [t for t in lines if sum(t in theirs for theirs in near) >= min(3, len(near))]
            want = plain_common(some, usable[0][1])
            rest = iter(usable[0][1])
            assert cut <= set(some) and all(any(lines[k] == y for y in rest) for k in gone.get(i, []))
        articles = sum(z == htmltext.ARTICLE for _, z in found)
        assert len(gone.get(i, [])) == want or articles and len(gone.get(i, [])) <= want
        zone = htmltext.ARTICLE if articles else htmltext.PLAIN
        assert texts[i] == "\n\n".join(t for k, (t, z) in enumerate(found) if z == zone and k not in set(gone.get(i, [])))


def test_long_pages():
    """40,000 tags without a partner, and lines too many for one table."""
    page = "<div>" * 20_000 + "</p>" * 20_000 + "text"
    assert htmltext.blocks(page) == [("text", htmltext.PLAIN)]
    rng = random.Random(4)
    a, b = ([rng.randrange(3000) for _ in range(n)] for n in (700, 900))
    whole, before = htmltext._common(a, b), htmltext.TABLE_BITS
    rest = iter(b)
    assert len(whole) == plain_common(a, b) and whole == sorted(set(whole)) and all(any(a[i] == y for y in rest) for i in whole)
    try:
        for bits in (1, 1000, 300 * 900):
            htmltext.TABLE_BITS = bits
            assert htmltext._common(a, b) == whole
            few, more = ([rng.randrange(4) for _ in range(n)] for n in (37, 41))
            htmltext.TABLE_BITS = before
            want = htmltext._common(few, more)
            htmltext.TABLE_BITS = bits
            assert htmltext._common(few, more) == want
    finally:
        htmltext.TABLE_BITS = before


def test_copies_are_no_partners(spark):
    """The nearest page carries the same article; the next one tells the template."""
    page = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    story = "a long story that two pages of the host carry"
    rows = [(1, "http://a.org/x/1", page("Menu", story, "Imprint")), (2, "http://a.org/x/2", page("Menu", story, "Imprint")), (3, "http://a.org/y/1", page("Menu", "another story", "Imprint")), (4, "http://b.org/1", page(story)), (5, "http://b.org/2", page(story))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.id: r.text for r in htmltext.main_text(df).collect()} == {1: story, 2: story, 3: "another story", 4: story, 5: story}


def test_neighbours_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, f"http://h.org/{i % 7}/{i % 13}/{i}") for i in range(400)], "page_id long, url string")
    urls = {i: f"http://h.org/{i % 7}/{i % 13}/{i}" for i in range(400)}
    want = {i: nearest(urls, i) for i in urls}
    for n in ("1", "4", "9", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {r.id: (r.others, r.depths) for r in htmltext.neighbours(rows, "page_id", "url").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "'", '"', " ", "=", ":", "AKIA", "ABCDEFGH0123", "deadbeef", "0123456789abcdef", "é", "🙂", "\n", "x", "token: secret: abcdefghij", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [s for s in secrets.point_spans(text.encode()) if s[1] < 3] == plain_spans(text), text


def test_incremental_entropy():
    rng = random.Random(3)
    run = bytes(rng.choice(b"abcdefgh0123456789") for _ in range(300))
    for size in (20, 24):
        got = list(secrets.window_entropies(run, size))
        assert len(got) == len(run) - size + 1
        for i, bits in enumerate(got):
            part = run[i : i + size]
            want = -sum(part.count(b) / size * math.log2(part.count(b) / size) for b in set(part))
            assert bits == pytest.approx(want, abs=1e-9)


def plain_entropy_spans(data):
    """Every window of every class by itself, with counts anew, as covered places."""
    covered = set()

    def scrambled(part):
        kinds = ["A" if chr(b).isupper() else "a" if chr(b).islower() else "" for b in part]
        changes = sum({x, y} == {"A", "a"} for x, y in zip(kinds, kinds[1:], strict=False))
        return 4 * kinds.count("A") >= len(part) and 4 * kinds.count("a") >= len(part) and 3 * changes >= len(part) - 1

    mixed = lambda part: 2 <= sum(chr(b) in "0123456789" for b in part) < len(part) or scrambled(part)
    listed = lambda part: part in secrets.ORDERED or any(a.fullmatch(part) for a in secrets.ALLOWED + (() if scrambled(part) else secrets.WORDS))
    for m in secrets.CANDIDATE.finditer(data):
        if not mixed(m[0]) or listed(m[0]):
            continue
        for runs, size, least in secrets.CLASSES.values():
            for r in runs.finditer(m[0]):
                for i in range(len(r[0]) - size + 1):
                    part = r[0][i : i + size]
                    bits = -sum(part.count(b) / size * math.log2(part.count(b) / size) for b in set(part))
                    if not listed(r[0]) and mixed(r[0]) and mixed(part) and bits >= least - 1e-9:
                        covered |= set(range(m.start() + r.start() + i, m.start() + r.start() + i + size))
    return covered


def test_entropy_spans_as_plain_windows():
    rng = random.Random(13)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFabcdef0123456789+/=", "ab12", "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    found = 0
    for _ in range(400):
        text = "".join("".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60))) + rng.choice([" ", "\n", ". ", "=", ":", "é"]) for _ in range(6)) if rng.random() < 0.3 else " ".join("".join(rng.choice(k) for _ in range(rng.randrange(60))) for k in rng.choices(kinds, k=5))
        data = text.encode()
        spans = secrets.entropy_spans(data)
        got = {x for a, b in spans for x in range(a, b)}
        want = plain_entropy_spans(data)
        assert got == want, text
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        found += len(spans)
    assert found > 200


def test_entropy_finds_keys_and_leaves_text():
    key = b"sk8Jd02kLq9ZxT7vPw3RmB5nYc1H"
    assert secrets.entropy_spans(b"use " + key + b" now") == [(4, 4 + len(key))]
    assert secrets.entropy_spans(b"use " + key + b" now", frozenset([key])) == []
    for text in (b"123e4567-e89b-12d3-a456-426614174000", b"abcdefghijklmnopqrstuvwxyz0123456789", b"a1b2a1b2a1b2a1b2a1b2a1b2", b"some-long-page-name-of-2024-in-words", b"Donaudampfschifffahrtsgesellschaft2024", b"thention" * 8, b"2024-11-26-13-09-00-000000", b"getInstanceFromTheFactoryBeanManager", b"ABSTRACTMETHODNAMESINCAPITALS", b"XMLHttpRequestUploadEventTarget"):
        assert secrets.entropy_spans(b"x " + text + b" y") == []


@pytest.mark.parametrize("letters,size,least", [("base62", 20, 0.95), ("base62", 32, 0.95), ("hex", 24, 0.9), ("letters", 32, 0.9), ("letters", 24, 0.8), ("base64", 40, 0.9)])
def test_recall_of_random_keys(letters, size, least):
    """Shares of planted keys of which four fifths are found."""
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    letters = {"letters": abc, "base62": abc + "0123456789", "hex": "0123456789abcdef", "base64": abc + "0123456789+/"}[letters]
    rng, found = random.Random(size), 0
    for _ in range(500):
        key = "".join(rng.choice(letters) for _ in range(size)).encode()
        found += sum(min(b, 4 + size) - max(a, 4) for a, b in secrets.entropy_spans(b"use " + key + b" now")) >= 0.8 * size
    assert found >= least * 500


def test_spans_of_documents(spark, docs):
    rows = {r.doc_id: r for r in secrets.op10_entropy_secrets(spark, SMALL).collect()}
    for d in docs.collect():
        want = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(d.text or "")]
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in secrets.KINDS[:3])


def test_redaction_of_odd_rows(odd, none):
    out = secrets.redact(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] == "[ASSIGN]" and texts[1] is None and texts[2] == "" and all(texts[r.doc_id] == r.text for r in odd.collect() if r.doc_id != 10)
    assert secrets.redact(none).count() == 0 and secrets.secret_spans(none).count() == 0
    spans = {r.id: r.spans for r in secrets.secret_spans(odd).collect()}
    assert spans[1] == [] and [(s.kind, s.start, s.end) for s in spans[10]] == [("assign", 0, 25)]


def test_text_buffers():
    from slicewise.llm.common import text_buffer, word_spans

    column = pa.array(["x", None, "", "a  b\n", "é c"])
    for part in (column, column[1:4], column[2:3], column[:0]):
        flat, at = text_buffer(part)
        want = [(x or "").encode() for x in part.to_pylist()]
        assert [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        starts, stops, row = word_spans(flat, at)
        assert [(int(r), flat[s:e].tobytes()) for s, e, r in zip(starts, stops, row, strict=True)] == [(i, w) for i, t in enumerate(want) for w in t.split()]
