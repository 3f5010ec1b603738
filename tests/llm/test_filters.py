"""Url rules, mixing, personal data, languages and toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nodeloom.llm import langid, mixing, pii, toxicity, url_filter

FIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_literal_tokens():
    assert url_filter.literal_tokens(r"://([a-z0-9-]+\.)*ads-track\.") == ["track"]
    assert url_filter.literal_tokens(r"[?&]affiliate=[a-z0-9]+") == ["affiliate"]
    assert url_filter.literal_tokens(r"/a/b+/c") == ["a"]
    assert url_filter.literal_tokens(r"/one/|/two/") == [] == url_filter.literal_tokens(r"ads")


def test_urls(spark):
    rows = [
        (1, "http://Shop.Example.com/en/1?x"), (2, "https://www.example.com/en/2#a"), (3, "http://a.net/es/"), (4, "http://a.net/de/"), (5, None), (6, "no url"), (7, "http://m.ads-track.example.org/x"),
        (8, "http://m.ads-track.example.com/fr/"), (9, "http://x.org/popunder/12.js"), (9, "http://x.org/popunder/12.js"), (10, "http://notexample.com/en/"), (11, "http://com"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("x"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect())
    assert got == [
        (1, "shop.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"), (3, "a.net", "/es/", "net/es/", "block"), (4, "a.net", "/de/", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "m.ads-track.example.org", "/x", None, "block"), (8, "m.ads-track.example.com", "/fr/", "com/", "allow"),
        (9, "x.org", "/popunder/12.js", None, "block"), (9, "x.org", "/popunder/12.js", None, "block"), (10, "notexample.com", "/en/", "com/", "allow"), (11, "com", "", None, "allow"),
    ]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_thousands_of_rules_from_a_table(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{i}" for i, (a, b) in enumerate((x, y) for x in ("ads", "win", "pop", "trk") for y in ("shop", "zone", "club")) for _ in range(1)]
    patterns = sorted({rf"://([a-z0-9-]+\.)*{rng.choice(words)}-{i}\." for i in range(1500)} | {rf"/{rng.choice(words)}/{i}/[0-9]+" for i in range(1500)} | {r"[?&]id=(aa|bb)$", "sho+p9"})
    rows = [(None, None, None, p) for p in patterns] + [("allow", "org", "/", None), ("block", "bad.org", "/x/", None), ("block", "bad.org", "/x/", None)]
    table = spark.createDataFrame(rows, "verdict string, host string, path string, pattern string")
    urls = [f"http://m.{rng.choice(words)}-{rng.randrange(1600)}.net/q" for _ in range(150)] + [f"https://x.net/{rng.choice(words)}/{rng.randrange(1600)}/{rng.choice(['7', 'a'])}" for _ in range(150)]
    urls += ["http://a.b/?id=aa", "http://a.b/shooop9", "http://bad.org/x/1", "http://good.bad.org/y", "nothing", "", "http://long.net/" + "a1/" * 200_000 + "?id=bb", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'r' AS rule", "'h' AS host", "1 AS matched")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules=table).collect()}
    compiled = [(p, re.compile(p)) for p in patterns]
    tried = 0
    for i, url in enumerate(urls):
        hit = next((p for p, c in compiled if c.search((url or "").lower())), None)
        assert got[i].matched == hit, url
        if got[i].rule is None:
            assert got[i].verdict == ("allow" if hit is None else "block")
        tried += got[i].tried
    assert (got[302].rule, got[302].verdict, got[303].rule, got[303].verdict) == ("bad.org/x/", "block", "org/", "allow")
    assert sum(r.matched is not None for r in got.values()) > 50 and tried < 0.05 * len(urls) * len(patterns)
    with pytest.raises(ValueError):
        url_filter.build_index(("a",) * (url_filter.MOST_RULES + 1), {})


def shares(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while True:
        left, w = 1.5 * sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)


def test_mixing_reaches_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 11)), [None, "a", "b", "c", "d", "big", "big", "big"][i % 8]) for i in range(1600)] + [(9000, None, "a"), (9001, "", "a"), (9002, " \t", "empty"), (None, "x y", "a"), (3, "w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    source = defaultdict(int)
    for _, t, s in rows:
        source[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = shares(source), defaultdict(int)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    by_size = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_size == {(source[s], round(target[s], 6)) for s in source}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for r in got:
        taken[r.source_size] += r.taken
    for s, n in source.items():
        if list(source.values()).count(n) == 1:
            assert abs(taken[n] - target[s]) <= 11
    copies = mixing.mixed(df.drop("size"))
    words = copies.select(F.sum(F.regexp_count("text", F.lit(mixing.WORDS)))).first()[0]
    assert words == sum(r.taken for r in got)
    assert mixing.mix_sources(df.where("false")).count() == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FIND.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_entities(spark):
    texts = [
        None, "", "mail a.b+c@x-y.co.uk, x@y", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (499) 555-6503 +12 3", "é😀 4111111111111111 é a@b.c%d@e.f",
        "1" * 5000, "a.b@" * 400 + "c.d", " ".join(f"10.0.0.{i % 256}" for i in range(700)),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = pii.digests(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in FIND]
        assert r.spans.split(",")[: len(want)] == want
    assert pii.digests(df.where("false")).count() == 0


def test_contexts_discover_identifiers(spark):
    seeds = [f"client reachable at number +1 (2{i:02d}) 555-01{i:02d} daily thanks {i}" for i in range(20)]
    keys = [f'noise word{i} password={"ab3c9f" * 2}{i:03d}x and more' for i in range(4)] + [f"some QZKL{'ABCDEFGH'[i] * 6}7{i}WXYZ in prose" for i in range(4)]
    plain = [f"the item the 2024{i:02d}{i}1 of the store, the end of the day" for i in range(4)]
    texts = [*seeds, "client reachable at number REF-9912345 daily", "other words REF-9912399 here", *keys, *plain, "password=zz91x22y44qq", "a password for the house"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "id"] for r in pii.digests(df).collect()}
    found = {i - 15: v for i, v in found.items()}
    assert found[5] == ["REF-9912345"] and found[6] == []
    assert [found[i] for i in range(7, 11)] == [[f"{'ab3c9f' * 2}{i:03d}x"] for i in range(4)]  # password=, of which one stands in prose
    assert [found[i] for i in range(11, 15)] == [[t.split()[1]] for t in keys[4:]]  # the start QZKL
    assert all(found[i] == [] for i in range(15, 19)) and found[19] == ["zz91x22y44qq"]
    text = pii.find_spans(df.where("doc_id in (0, 5)").unionByName(df.where("doc_id in (1, 2, 3)"))).select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in text.collect()}[0] == "client reachable at number <phone> daily thanks 0"


def test_clashing_names_and_long_texts_of_personal_data(spark):
    names = ("base", "spans", "row", "own", "found", "tokens", "kind", "start", "pattern", "__row", "value")
    long = "é😀 " + " ".join(f"10.0.{i % 256}.{i % 99} w{i}" for i in range(3000))
    rows = [(1, "mail a@b.org now", *names), (1, "mail a@b.org now", *names), (None, None, *names), (2, "", *names), (3, long, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pii.find_spans(df).withColumn("masked", pii.masked(F.col("text"), F.col("spans"))).collect()
    assert len(got) == 5
    for r in got:
        assert all(r[n] == n for n in names if n not in ("base", "spans"))
        assert [f"{s.kind}:{s.start}:{s.stop}" for s in r.base] == spans(r.text)
        assert r.masked == (None if r.text is None else re.sub(r"10\.0\.[0-9]+\.[0-9]+", "<ip>", r.text).replace("a@b.org", "<email>"))


def test_entities_stay_with_their_text(spark, tmp_path):
    for i in range(6):
        texts = [(10 * i + j, f"text {i} {j} " + "x" * (i + j) + (f" a{i}{j}@example.org" if j % 2 else "")) for j in range(4 + i)]
        spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", 12)
        found = pii.find_spans(spark.read.parquet(f"{tmp_path}/d"))
        spark.conf.set("spark.sql.files.minPartitionNum", 1)  # as after a lost executor: the next scan has other splits
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(rows) == 39
    for r in rows:
        assert [(s.value, r.text[s.start : s.stop]) for s in r.base] == ([(r.text.split()[-1],) * 2] if "@" in r.text else [])


def test_languages(spark):
    words = {"aa": "lor ipsam dolar sitta", "bb": "quick brown foxes jumped"}
    rows = [(i, words[lang] + f" {words[lang].split()[i % 4]}", lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "dolarsitt", None), (None, "brownish", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(df)
    assert model.languages == ("aa", "bb")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= got[i].score <= 1 for i in range(200))
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert langid.identify(df.where("false"), langid.fit(df.where("false"))).count() == 0


def test_toxicity_is_learned_on_what_is_not_held_out(spark):
    rows = [(i, f"plain text number{i % 13} with words " + ("vile insult" if i % 4 == 0 else "kind remark")) for i in range(800)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs.drop("toxicity"), labels).collect()}
    held = [i for i in range(800) if got[i].held_out]
    assert held == [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.5
    empty = toxicity.classify(docs.drop("toxicity"), labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in empty] == [0.0]


@pytest.mark.parametrize("scorer", [toxicity.Scorer(toxicity.Weights(10, toxicity.np.zeros(0, int), toxicity.np.zeros(0), -1.0))])
def test_no_texts(scorer):
    assert len(scorer.scores([])) == 0


def backoff_model(rows, limits):
    """Tables of -log10 shares by language, words first and then n-grams by size, with a penalty where an entry is missing."""
    words = defaultdict(lambda: defaultdict(int))
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[lang][w] += 1
    tables = []
    for size in range(limits.longest + 1):
        kept = {}
        for lang, counts in words.items():
            own = defaultdict(int)
            for w, n in counts.items():
                for g in [w] if size == 0 else [f" {w} "[i : i + size] for i in range(len(w) + 3 - size)]:
                    own[g] += n
            total = sum(own.values())
            best = sorted(own, key=lambda g: (-own[g], g))[: limits.words if size == 0 else limits.grams]
            kept |= {(lang, g): math.log10(total / own[g]) for g in best}
        tables.append(kept)
    return sorted(words), tables


def backoff(text, languages, tables):
    seen = re.findall(r"[^\W\d_]+", text.lower())
    if not seen:
        return "und", 0.0
    total = [0.0] * len(languages)
    for w in seen:
        for size in [0, *range(len(tables) - 1, 0, -1)]:
            grams = [w] if size == 0 else [f" {w} "[i : i + size] for i in range(len(w) + 3 - size)]
            met = [g for g in grams if any((x, g) in tables[size] for x in languages)]
            if met:
                penalty = 1.0 + max(tables[size].values())
                total = [t + sum(tables[size].get((x, g), penalty) for g in met) / len(met) for t, x in zip(total, languages, strict=True)]
                break
    mean = [t / len(seen) for t in total]
    best = min(range(len(languages)), key=lambda i: (mean[i], i))
    return languages[best], 1 / sum(10 ** (mean[best] - m) for m in mean)


def test_languages_against_a_plain_model(spark):
    rng = random.Random(2)
    stock = {x: ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(60)] for x, alphabet in (("aa", "abcdé"), ("bb", "bcdefü"), ("cc", "defgh"))}
    rows = [(i, " ".join(rng.choice(stock[x]) for _ in range(rng.randint(1, 25))), x) for i in range(240) for x in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000, "same word", None), (1000, "same word", None), (1001, "zzz", None), (1002, "bcd " * 40_000, None), (1003, "", None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS held_out", "'y' AS lang_pred")
    limits = langid.Limits(words=30, grams=40, longest=3)
    learned = [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 4 != 2]
    languages, tables = backoff_model(learned, limits)
    got = langid.identify(docs, langid.fit(docs, limits)).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(backoff(t, languages, tables))
    assert len(got) == len(rows)
    for r in got:
        assert any(r.lang_pred == x and r.score == pytest.approx(s, abs=1e-4) for x, s in want[r.doc_id]), r


def features_of(text):
    w = re.findall(r"\w+", text.lower())
    return {("w", x) for x in w} | {("s", x[:5]) for x in w} | {(g, w[i], w[i + g]) for g in (1, 2) for i in range(len(w) - g)}


def test_toxicity_against_plain_ftrl(spark):
    rng = random.Random(4)
    words = [f"wort{i}x" for i in range(40)] + ["vile", "scum"]
    rows = [(i, " ".join(rng.choice(words[:40]) for _ in range(rng.randint(3, 12))) + (" vile scum" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(3, rows[3][1]), (500, None), (501, ""), (502, "vile " * 50_000), (None, "scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "'y' AS held_out", "2 AS predicted", "3 AS toxicity")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    s = toxicity.Settings(l1=0.5, passes=2)
    known = [(i, t) for i, t in rows[:150] if zlib.crc32(str(i).encode()) % 5]
    order = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    known.sort(key=lambda x: order[x])
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f == "bias":
            return -z[f] / ((s.beta + math.sqrt(n[f])) / s.alpha)
        return 0.0 if abs(z[f]) <= s.l1 else -(z[f] - math.copysign(s.l1, z[f])) / ((s.beta + math.sqrt(n[f])) / s.alpha + s.l2)

    def score(text):
        return 1 / (1 + math.exp(-sum(map(weight, [*features_of(text), "bias"]))))

    for _ in range(s.passes):
        for i, t in known:
            g = score(t) - int(i % 3 == 0)
            for f, w in [(f, weight(f)) for f in [*features_of(t), "bias"]]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w
                n[f] += g * g
    got = toxicity.classify(docs, labels, s).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        assert r.score == pytest.approx(score(text), abs=1e-4) and r.predicted == int(r.score >= 0.5)
    nothing = docs.where("false")
    assert toxicity.classify(nothing, labels).count() == 0 and toxicity.classify(docs, labels.where("false")).count() == len(rows)
    small = toxicity.fit(docs, labels, toxicity.Settings(characters=1))
    assert small.bias is None or len(small.features) >= 0
