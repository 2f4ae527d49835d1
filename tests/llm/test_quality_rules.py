import math
import random
import re

from edge import SCHEMA, edge_docs, edge_rows, empty_docs, prose, with_clashes

from gridpv.llm import quality_rules as qr

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(qr.WORD, text)
    places: dict = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(qr.WORD, line):
            copies += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, copies, len(repeated), failed)


def test_signals_match_plain_python(spark):
    extra = [
        (100 + i, t, lang, "s", 1)
        for i, (t, lang) in enumerate(
            [("a b c a b c", "en"), ("x\nx\n \n \nx y\nx", "fr"), ("a a a a", None), ("# $% <b>|*&\n" * 30, "xx"), (prose(9, 70) + "\n" + prose(9, 70), "de"),
             ("a b c d a b c x b c d", "es")]
        )
    ]
    rows = edge_rows() + extra
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in qr.judge(docs, qr.references(docs)).select("doc_id", "text", *SIGNALS).collect()), key=repr)
    assert got == sorted(((r[0], r[1], *brute(r[1])) for r in rows), key=repr)


def test_verdict_tells_prose_from_junk(spark):
    rnd = random.Random(1)
    listed = qr.COMMON_WORDS["en"]
    sentence = lambda s: " ".join(rnd.choice(listed) if rnd.random() < 0.35 else w for w in prose(s, 150).split())
    good = [(i, sentence(i), "en", "s", 1) for i in range(40)]
    junk = [(50 + i, " ".join(w.upper() + "!!" for w in prose(60 + i, 150).split()), "en", "s", 1) for i in range(4)]
    junk += [(60 + i, " ".join(w + "$$$" for w in prose(70 + i, 150).split()), "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(good + junk, SCHEMA)
    kept = {r["doc_id"] for r in qr.judge(docs, qr.references(docs)).where("kept").collect()}
    assert kept == {r[0] for r in good}


def spiced(seed, n, lang, share):
    """Prose of ``n`` words, of which a share are common words of the language."""
    rnd = random.Random(seed)
    return " ".join(rnd.choice(qr.COMMON_WORDS[lang]) if rnd.random() < share else w for w in prose(seed, n).split())


def test_a_long_text_without_common_words_goes(spark):
    good = [(i, spiced(i, 150, "en", 0.35), "en", "s", 1) for i in range(40)]
    bare = [(50 + i, spiced(90 + i, 150, "en", 0), "en", "s", 1) for i in range(3)]
    few = [(60, spiced(95, 150, "en", 0.1), "en", "s", 1), (61, spiced(96, qr.WORD_GUARD - 1, "en", 0), "en", "s", 1)]
    other = [(62, spiced(97, 150, "en", 0), "xx", "s", 1)]
    docs = spark.createDataFrame(good + bare + few + other, SCHEMA)
    rows = qr.judge(docs, qr.references(docs)).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {50, 51, 52}
    assert all(r["class_distance"] <= qr.CLASS_LIMIT for r in rows)


def classes_of(text):
    import unicodedata

    kind = {"space": 0, "upper": 0, "lower": 0, "digit": 0, "symbol": 0, "other": 0}
    for c in text:
        category = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            kind["space"] += 1
        elif category == "Lu":
            kind["upper"] += 1
        elif category[0] == "L":
            kind["lower"] += 1
        elif category == "Nd":
            kind["digit"] += 1
        else:
            kind["symbol" if c in "#*$%&|<>" else "other"] += 1
    return [kind[k] for k in qr.CLASSES]


def common_of(text, lang):
    words = re.findall(qr.WORD, text)
    listed = qr.COMMON_WORDS.get(lang, [])
    counts = [words.count(w) for w in listed]
    return [*counts, len(words) - sum(counts)]


def share(counts):
    return [c / sum(counts) if sum(counts) else 0.0 for c in counts]


def shannon(p, q):
    part = sum(a * math.log2(2 * a / (a + b)) if a else 0 for x, y in ((p, q), (q, p)) for a, b in zip(x, y, strict=True))
    return math.sqrt(max(part / 2, 0))


def test_references_distances_and_verdict_match_plain_python(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(90):
        lang = rnd.choice(["en", "fr", "de", " EN", "xx", None])
        name = (lang or "").strip().lower()
        text = spiced(i, rnd.choice([20, 60, 120, 300]), name if name in qr.COMMON_WORDS else "en", rnd.choice([0, 0.05, 0.3, 0.4]))
        text = rnd.choice([str, str, str, str.upper, lambda t: t.replace(" ", " 12 $% "), lambda t: t.replace("e", "é\n")])(text)
        rows.append((i, text, lang, "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    name = lambda lang: (lang or "").strip().lower() if (lang or "").strip().lower() in qr.COMMON_WORDS else qr.ALL
    long = [(t, name(lang)) for _, t, lang, _, _ in rows if len(re.findall(qr.WORD, t)) >= qr.MIN_WORDS]
    want = {}
    for lang in {n for _, n in long} | {qr.ALL}:
        shares = [share(classes_of(t)) for t, n in long if lang in (n, qr.ALL)]
        middle = [sorted(s[i] for s in shares)[(len(shares) - 1) // 2] for i in range(len(qr.CLASSES))]
        words = [share(common_of(t, lang)) for t, n in long if n == lang]
        common = [sum(w[i] for w in words) / len(words) for i in range(len(words[0]))] if lang != qr.ALL else [1.0]
        want[lang] = {"classes": [m / sum(middle) for m in middle], "common": common}
    got = qr.references(docs)
    assert got.keys() == want.keys()
    for lang, kinds in want.items():
        for kind, values in kinds.items():
            assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[lang][kind], values, strict=True)), (lang, kind)
    verdicts = set()
    for r in qr.judge(docs, got).collect():
        lang = name(r["lang"])
        by_class = shannon(share(classes_of(r["text"])), want[lang]["classes"])
        by_word = shannon(share(common_of(r["text"], lang)), want[lang]["common"])
        assert math.isclose(r["class_distance"], by_class, abs_tol=1e-6) and math.isclose(r["word_distance"], by_word, abs_tol=1e-6)
        odd = r["word_chars"] >= qr.GUARD and (by_class > qr.CLASS_FAR or by_class > qr.CLASS_LIMIT and by_word > qr.WORD_LIMIT)
        odd = odd or r["n_words"] >= qr.WORD_GUARD and by_word > qr.WORD_FAR
        assert r["kept"] == (not brute(r["text"])[-1] and not odd)
        verdicts.add((r["base_failed"], odd))
    assert len(verdicts) >= 3


def test_empty_table_and_null_language(spark):
    assert qr.judge(empty_docs(spark), qr.references(empty_docs(spark))).count() == 0
    docs = edge_docs(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    row = qr.judge(docs, qr.references(docs)).where("doc_id = 1").first()
    assert row["kept"] and row["class_distance"] is not None and not row["base_failed"]


def test_plan_has_no_python_and_filters_stay_above(spark):
    docs = edge_docs(spark)
    plan = qr.judge(docs, qr.references(docs)).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("xxhash64") == 1 and plan.count("regexp_extract_all") == 1
