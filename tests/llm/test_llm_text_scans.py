import random
import re
import time
import zlib

import numpy as np
import pytest

from llm_data import SF, frame, rows, sample
from vitrine.llm import decontaminate as D
from vitrine.llm import language_id as P
from vitrine.llm import license_scan as A


# -- licences ---------------------------------------------------------------------------------------

def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in A.BASE.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))


TEXTS = ["Released under the MIT License. mit  license!", "the general public license mit license", "MIT-LICENSE xmit license",
         "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0",
         "// SPDX-License-Identifier: MIT AND", "GNU Lesser General Public License", "mit license" * 3]


def test_base_columns_equal_brute_force(spark):
    data = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in sample()]
    data += [(90_000 + i, t, "en", "a", None) for i, t in enumerate(TEXTS)] + rows()
    got = A.license_scan(frame(spark, data)).collect()
    want = sorted(((d[0], *plain_base(d[1])) for d in data), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[90_003].labels == "apache,gpl,mit" and by[90_003].score == 1.0
    assert by[90_003].expressions == ["(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"]
    assert by[90_004].score == 0.3 and by[90_005].labels == "gpl,lgpl"
    assert A.license_scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text, postfix", [
    ("MIT", "MIT"), ("a OR b AND c", "a b c and or"), ("(a or b) and c", "a b or c and"),
    ("a and b with x or c", "a b x with and c or"), ("a or b or c", "a b or c or")])
def test_postfix(text, postfix):
    assert " ".join(A.to_postfix(text)) == postfix


@pytest.mark.parametrize("text", ["", "and", "a b", "a or", "(a", "a)", "a with (b)", "(a or b) with x", "a with x with y", "a & b"])
def test_ill_formed(text):
    assert A.to_postfix(text) is None


def test_alternatives():
    sets, text = A.evaluate(A.to_postfix("(a or b) and c"))
    assert sorted(sets) == [["a", "c"], ["b", "c"]] and text == "(a OR b) AND c"


@pytest.mark.parametrize("rest, labels, score, expressions", [
    ("MIT see LICENSE", "mit", 1.0, ["MIT"]), ('MIT", "x": 1', "mit", 1.0, ["MIT"]), ("MIT, (c) 2020", "mit", 1.0, ["MIT"]),
    ("(MIT OR Apache-2.0) in one line of text", "apache,mit", 1.0, ["MIT OR Apache-2.0"]),
    ("GPL-2.0 WITH x. All else", "gpl", 0.5, ["GPL-2.0 WITH x"]),
    ("GPL-2.0+ WITH Classpath-exception-2.0. All else", "gpl", 1.0, ["GPL-2.0+ WITH Classpath-exception-2.0"]),
    ("see the file", "", 0.3, ["see"]), ("hello", "", 0.3, ["hello"]), ("MIT OR nothing", "mit", 0.3, ["MIT OR nothing"]),
    ("LicenseRef-Own AND BSL-1.0", "bsl-1.0,licenseref-own", 0.5, ["LicenseRef-Own AND BSL-1.0"]),
    ("GPL-9.9-or-later", "gpl", 1.0, ["GPL-9.9-or-later"]),
    ("MIT SPDX-License-Identifier: ISC", "isc,mit", 1.0, ["MIT", "ISC"]), ("MIT AND", "mit", 0.3, ["MIT"]),
    ("MIT AND (ISC", "mit", 0.3, ["MIT"]), ("", "", 0.3, []), ("(MIT", "", 0.3, []), ("& MIT", "", 0.3, [])])
def test_longest_expression_at_the_start(rest, labels, score, expressions):
    assert A.Scanner().scan(f"so SPDX-License-Identifier: {rest}".encode())[5:] == (labels, score, expressions)


def test_many_alternatives_are_neither_joined_nor_listed_by_the_scan():
    postfix = A.to_postfix(" and ".join(f"(a{i} or b{i})" for i in range(9)))
    assert len(A.evaluate(postfix)[0]) == 2 ** 9
    long = " AND ".join(f"(LicenseRef-a{i} OR LicenseRef-b{i})" for i in range(60))
    scanned = A.Scanner().scan(f"SPDX-License-Identifier: {long}".encode())
    assert scanned[7] == [long] and len(scanned[5].split(",")) == 120


def test_megabytes_of_tags_or_operators_take_seconds():
    scanner, began = A.Scanner(), time.monotonic()
    for text in ("SPDX-License-Identifier: MIT " * 70_000, "SPDX-License-Identifier: " + "MIT AND " * 250_000 + "ISC",
                 "SPDX-License-Identifier: " + "(MIT OR " * 200_000 + "ISC" + ")" * 200_000,
                 "SPDX-License-Identifier: " + " OR ".join(f"LicenseRef-{i}" for i in range(80_000))):
        assert "mit" in scanner.scan(text.encode())[5] or "licenseref-79999" in scanner.scan(text.encode())[5]
    assert time.monotonic() - began < 30


# -- languages --------------------------------------------------------------------------------------

def plain_bits(counts, langs_bytes, body, order=3):
    """PPM (method C, exclusion) of one language, straight from n-gram counts."""
    total = 0.0
    for i in range(len(body)):
        p, free, done = 1.0, set(range(256)), False
        for k in range(min(order, i), -1, -1):
            context = counts.get((k, body[i - k:i]), {})
            seen = {s: c for s, c in context.items() if s in free}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if body[i] in seen:
                p *= seen[body[i]] / (n + d)
                done = True
                break
            p *= d / (n + d)
            free -= set(seen)
        if not done:
            p /= len(free)
        total -= np.log2(p)
    return total


def test_code_lengths_equal_a_plain_ppm(spark):
    texts = {"en": "the cat sat on the mat, the end", "de": "die katze saß auf der matte, ende"}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = P.fit(docs, sample_docs=10)
    assert model.langs == ["de", "en"]
    for probe in ("the mat", "saß der ZAUN~", "x", "the the the"):
        body = probe.encode().lower()
        for at, lang in enumerate(model.langs):
            counts, train = {}, texts[lang].encode().lower()
            for k in range(4):
                for i in range(len(train) - k):
                    c = counts.setdefault((k, train[i:i + k]), {})
                    c[train[i + k]] = c.get(train[i + k], 0) + 1
            assert model.code_lengths(probe.encode())[at] == pytest.approx(plain_bits(counts, None, body), rel=1e-4)
    long = ("the cat " * 300).encode()
    assert model.code_lengths(long) == pytest.approx(model.code_lengths(long, piece=97), rel=1e-6)


def test_held_out_accuracy(spark):
    docs = {d["doc_id"]: d["lang"] for d in sample(sf="/root/testdata/sf0.01")}
    got = P.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) >= 0.97


def test_the_sample_is_bounded_whatever_ids_and_copies(spark):
    """Null ids, one id for all rows and many copies: the bound holds and is reached."""
    texts = [f"text number {i} of many" for i in range(900)]
    for ids in (lambda i: None, lambda i: 7, lambda i: i):
        data = [(ids(i), t, "en" if int(t.split()[2]) % 3 else "de") for i, t in enumerate(texts + texts[:5] * 60)]
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
        drawn = P.draw(docs, 50).collect()
        for lang in ("de", "en"):
            mine = [r for r in drawn if r.lang == lang]
            assert sorted(r.rank for r in mine) == list(range(1, 51)) and len({r.text for r in mine}) == 50
        few = P.draw(docs.filter("text LIKE '%number 1 of%' OR text LIKE '%number 3 of%'"), 50).collect()
        assert sorted((r.lang, r.text) for r in few) == [("de", texts[3]), ("en", texts[1])]


def _made_up(languages, texts, rng):
    data = []
    for lang in range(languages):
        script = 0x4e00 + 24 * lang
        words = ["".join(chr(script + rng.randrange(20)) for _ in range(rng.randint(2, 8))) for _ in range(300)]
        data += [(f"l{lang:02d}", " ".join(rng.choice(words) for _ in range(120))) for _ in range(texts)]
    return data


@pytest.mark.parametrize("languages", [4, 50])
def test_the_model_grows_with_its_text_alone(spark, languages):
    data = _made_up(languages, 6, random.Random(languages))
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string")
    model = P.fit(docs, sample_docs=5)
    size = sum(len(t.encode()) for _, t in data)
    print(f"{languages} languages: {model.nbytes} bytes of model, {size} bytes of text")
    assert model.langs == sorted({lang for lang, _ in data}) and model.nbytes < 20 * size
    found = {r.doc_id: r.lang_pred for r in P.identify(docs, model).collect()}
    assert sum(found[i] == lang for i, (lang, _) in enumerate(data)) >= 0.99 * len(data)
    with pytest.raises(ValueError):
        P.fit(docs, sample_docs=5, most_bytes=1000)


def test_usual_bits_tell_gibberish_and_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = P.fit(docs, sample_docs=100)
    usual = P.usual_bits(docs, model, texts=100, trained=100)
    assert set(usual) == set(model.langs)
    rng = random.Random(1)
    gibberish = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500))
    polish = "Szybki brązowy lis przeskakuje nad leniwym psem a potem idzie do domu i je kolację z przyjaciółmi"
    for text in (gibberish, polish, "Το γρήγορο καφέ αλεπού πηδάει πάνω από το σκυλί"):
        lang, _, bits = model.predict([text.encode()])[0]
        assert bits > 3 * usual[lang]
    known = [d for d in sample() if d["lang"] and len(d["text"] or "") > 200]
    found = model.predict([d["text"].encode() for d in known])
    assert sum(bits <= 3 * usual[lang] for lang, _, bits in found) >= 0.99 * len(known)
    assert P.usual_bits(docs.limit(0), P.fit(docs.limit(0))) == {}


def test_the_model_counts_every_labelled_text_once(spark):
    """More texts than any sample held, copies, and texts shorter than an n-gram."""
    texts = [f"text number {i} of {i * i} many" for i in range(700)] + ["a", "ab", "abc", ""]
    data = [(None, t, "en") for t in texts + texts[:40] * 3] + [(1, texts[0], "de"), (2, None, "en"), (3, "lost", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    want = {}
    for lang, mine in (("en", texts), ("de", texts[:1])):
        for body in (t.encode() for t in mine):
            for k in range(4):
                for i in range(len(body) - k):
                    key = (lang, k, int.from_bytes(body[i:i + k + 1], "big"))
                    want[key] = want.get(key, 0) + 1
    assert {(r.lang, r.k, r.gram): r.n for r in P.count_ngrams(docs).collect()} == want
    model = P.fit(docs)
    assert int(model.trees[model.langs.index("en")].counts[0].sum()) == sum(len(t) for t in texts)
    usual = P.usual_bits(docs, model)
    for lang, mine in (("en", texts), ("de", texts[:1])):
        bits = [b for _, _, b in model.predict([t.encode() for t in mine]) if b is not None]
        assert usual[lang] == pytest.approx(np.percentile(bits, 99), abs=2e-3)


@pytest.mark.parametrize("order", [0, 2, 3, 5])
def test_ngrams_of_a_text_cut_into_pieces(order):
    bodies = [bytes(random.Random(1).choices(range(250, 256), k=n)) for n in (0, 1, 3, 4, 40, 41)]
    for k, (grams, n) in enumerate(P._grams_of(bodies, order, 7)):
        want, got = {}, {}
        for body in bodies:
            for i in range(len(body) - k):
                key = int.from_bytes(body[i:i + k + 1], "big")
                want[key] = want.get(key, 0) + 1
        for g, c in zip(grams.tolist(), n.tolist()):
            got[g] = got.get(g, 0) + c
        assert got == want


def test_language_edges(spark):
    model = P.fit(frame(spark))
    got = sorted(((r.doc_id, r.lang_pred) for r in P.identify(frame(spark), model).collect()), key=str)
    for doc_id, lang in got:
        assert (lang == "und") == (doc_id in (3, 4, 5, 10)), (doc_id, lang)
    assert len(got) == len(rows())
    assert P.identify(frame(spark, []), model).count() == 0
    nothing = P.fit(frame(spark, []))
    assert {r.lang_pred for r in P.identify(frame(spark), nothing).collect()} == {"und"}


# -- decontamination ----------------------------------------------------------------------------------

def plain_score(item, text):
    """Smith-Waterman by the book."""
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for j, t in enumerate(text):
            row.append(max(0, above[j] + (w == t), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def words(text):
    return [w.decode() for w in A.words_of((text or "").encode())]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"changed{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(99)}")
        else:
            del words[at]
    return words


def test_leaks_equal_alignment_of_every_pair(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(6, 45)))) for i in range(12)]
    items += [(90, None), (91, "too short"), (92, items[0][1]), (93, "")]
    docs = []
    for i in range(80):
        filler = [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 60))]
        passage = edited(rng, items[rng.randrange(12)][1].split(), rng.randint(0, 9))
        docs.append((i, " ".join(filler + passage + filler[:7]), "en", "a", None))
    docs += rows()
    want = []
    for d in docs:
        for item, text in items:
            w = words(text)
            if len(w) >= 6:
                score = plain_score(w, words(d[1]))
                if score >= 0.8 * len(w) - 1e-9:
                    want.append((d[0], item, round(score / len(w), 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limits in ({}, {"range_words": 40}, {"max_items": 1}):
        got = D.leaks(frame(spark, docs), bench, **limits).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in got), key=str) == sorted(want, key=str), limits
    assert len(want) > 40
    assert D.leaks(frame(spark, []), bench).count() == 0
    assert D.leaks(frame(spark), bench.limit(0)).count() == 0


def searcher(spark, items, **options):
    return D.Searcher(D.build_index(spark.createDataFrame(items, "item_id long, text string"), **options))


def test_place_of_a_verbatim_passage(spark):
    item = "one two three four five six seven eight"
    found = searcher(spark, [(5, item), (None, "a b c d e f"), (7, "lone")])
    texts = [f"zero zero {item} nine", "", "x a b c d e f", "one two", "lone wolf"]
    assert found.leaks([t.encode() for t in texts]) == [(0, 5, 1.0, 2, 9, 6), (2, None, 1.0, 1, 6, 4), (4, 7, 1.0, 0, 0, 1)]
    assert [leak[1] for leak in searcher(spark, [(7, "lone"), (8, "lone wolf")], least_words=2).leaks([b"a lone wolf"])] == [8]


def test_seeds_at_the_border_of_two_texts_are_none(spark):
    found = searcher(spark, [(5, "one two three four five six")])
    assert found.leaks([b"one two three", b"four five six"]) == []


def test_missing_index_files_are_an_error(spark):
    import glob
    import os
    index = D.build_index(spark.createDataFrame([(5, "one two three four five six")], "item_id long, text string"))
    os.rename(*(lambda f: (f, f + ".gone"))(glob.glob(f"{index.folder}/seed-*.npy")[0]))
    with pytest.raises(RuntimeError, match="can't be read"):
        D.Searcher(index).leaks([b"one two three four five six"])


def test_a_large_benchmark_in_one_read_of_the_documents(spark):
    """Two hundred thousand items: the documents are scanned by one job, and the planted ones are found."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 500_000, (200_000, 12))
    items = [(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words.tolist())]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(8)
    docs = [(i, " ".join(["noise"] * 30 + [items[i * 997 % len(items)][1]] + ["more"] * 5)) for i in range(500)]
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, range_words=1 << 18)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i * 997 % len(items)) for i in range(500)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_short_items_equal_alignment_of_every_pair(spark):
    rng = random.Random(12)
    draw = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    items = [(i, draw(1 + i % 8, 25)) for i in range(32)] + [(90, None), (91, "?!"), (92, "w1 w1"), (93, "w2 w3 w2 w3 w2")]
    docs = [(i, draw(rng.randint(0, 25), 25), "en", "a", None) for i in range(60)]
    for i in range(60, 140):
        passage = items[rng.randrange(32)][1].split()
        passage = edited(rng, passage, rng.randint(0, 2) if len(passage) > 2 else 0)
        docs.append((i, " ".join(["other"] * 3 + passage + ["other"]), "en", "a", None))
    want = []
    for d in docs:
        for item, text in items:
            w = words(text)
            score = plain_score(w, words(d[1])) if w else 0
            if w and score >= 0.8 * len(w) - 1e-9:
                want.append((d[0], item, round(score / len(w), 9)))
    assert {len(words(text)) for _, item, _ in want for i, text in items if i == item} == set(range(1, 9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limits in ({}, {"range_words": 15}, {"max_items": 1}):
        got = D.leaks(frame(spark, docs), bench, **limits).collect()
        assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == sorted(want), limits


@pytest.mark.parametrize("item, same, other", [
    ("天气预报说明天下午有雷阵雨", "他说：天气预报说明天下午、有雷阵雨。出门带伞", "天气很好，我们明天下午去公园"),
    ("東京スカイツリーの高さは六百三十四メートル", "「東京スカイツリーの高さは六百卅四メートル」です", "京都タワーの高さは百三十一メートル"),
    ("กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย", "รู้ว่ากรุงเทพมหานครเป็นเมืองหลวงของประเทศไทยนะ", "เชียงใหม่อยู่ทางเหนือ"),
    ("𠮷野家の牛丼", "昨日𠮷野家の牛丼を食べた", "松屋のカレー")])
def test_unspaced_scripts_are_found(spark, item, same, other):
    assert [leak[:2] for leak in searcher(spark, [(5, item)]).leaks([other.encode(), same.encode()])] == [(1, 5)]


def test_spaced_scripts_keep_their_words():
    for text in ("Ünïcode — ça va ▁ naïve \U0001f600", "привет мир", "안녕 세상", "γειά σου", "ა ბგ", "हिन्दी भाषा"):
        assert D.tokens_of(text.encode()) == A.words_of(text.encode())
    assert D.tokens_of("AI：测试２ｘ，好".encode()) == [w.encode() for w in ("ai", "测", "试", "２ｘ", "好")]


def test_documents_with_test_items(spark):
    got = {(r.doc_id, r.item_id) for r in D.query(spark, SF).collect()}
    items = {i["item_id"]: " ".join(words(i["text"])) for i in sample("benchmark")}
    want = {(d["doc_id"], i) for d in sample() for i, t in items.items() if f" {t} " in f" {' '.join(words(d['text']))} "}
    assert want and want <= got
