"""Decontamination, mixing, tokens, toxicity, quality and extraction."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribegauge.llm import decontaminate, html_extract, mixing, quality, tokens, toxicity
from scribegauge.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], DOCS)


def substring_distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_against_full_alignment():
    rng = random.Random(11)
    for _ in range(250):
        item = "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 70)))
        noisy = list(item)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(noisy) + 1)
            if rng.random() < 0.5 and noisy[at:]:
                noisy[at] = rng.choice("xyz")
            else:
                noisy.insert(at, rng.choice("xyz"))
        pad = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 50))) for _ in range(2)]
        item, text = decontaminate.normalise(item), decontaminate.normalise(pad[0] + "".join(noisy) + pad[1])
        if not item:
            continue
        edits = substring_distance(item, text)
        found = decontaminate.Index.build([(1, item)]).search(text)
        assert bool(found) == (edits <= decontaminate.edit_budget(len(item)))
        if found:
            assert found[0][3] == edits == substring_distance(item, text[found[0][1] : found[0][2]])


def test_short_items_keep_their_budget():
    rng = random.Random(12)
    for length in (*range(8, 48), 200):
        for _ in range(4):
            item = "".join(rng.choice("abcdefghij") for _ in range(length))
            noisy = list(item)
            for at in rng.sample(range(length), length // 10):
                noisy[at] = "x"
            found = decontaminate.Index.build([(1, item)]).search("pad " + "".join(noisy) + " pad")
            assert found and found[0][3] == substring_distance(item, "".join(noisy))


def test_repetitive_items_and_texts():
    rng = random.Random(13)
    for _ in range(60):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 3))).strip() or "a"
        item = decontaminate.normalise(" ".join([unit] * rng.randint(3, 40)))
        noisy = "".join(rng.choice("xa") if rng.random() < 0.08 else c for c in item * rng.randint(1, 2))
        text = decontaminate.normalise("b b " + noisy + " a")
        found = decontaminate.Index.build([(1, item)]).search(text)
        edits = substring_distance(item, text)
        assert bool(found) == (edits <= decontaminate.edit_budget(len(item)))
        assert not found or found[0][3] == edits == substring_distance(item, text[found[0][1] : found[0][2]])
    began = time.time()
    item, text = " ".join(["word"] * 400), " ".join(["word"] * 390 + ["other"]) + " "
    assert decontaminate.Index.build([(1, item)]).search(decontaminate.normalise(text * 30))[0][3] <= 199
    assert decontaminate.Index.build([(1, "ab" * 500_000)]).search("ab" * 30_000) == []
    assert time.time() - began < 60


def test_decontamination_of_tables(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs far away into the dark wood"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (5, "kurz")], "item_id long, text string")
    rows = [(1, "x " + item.upper().replace("FOX", "FIX") + " y", "s"), (2, None, "s"), (3, "", "s"), (4, "nothing here", "s"), (5, "so KURZ\nist", "s"), (5, "so KURZ", "s"), (None, item, "s")]
    for chars in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (chars,))
        got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_matches(frame(spark, rows), bench).collect()), key=str)
        assert got == sorted([(1, 1, 1), (1, 4, 1), (5, 5, 0), (5, 5, 0), (None, 1, 0), (None, 4, 0)], key=str)
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()} == {2, 3, 4}
    assert decontaminate.find_matches(frame(spark, rows), bench.limit(0)).isEmpty()
    assert decontaminate.drop_contaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_exponent():
    counts = [900, 90, 9, 1]
    assert mixing.entropy(mixing.weights(counts, mixing.solve_exponent(counts, target_entropy=1.0))) == pytest.approx(1.0)
    shares = mixing.weights(counts, mixing.solve_exponent(counts, max_repetition=3.0))
    assert max(mixing.repetitions(counts, shares, None)) == pytest.approx(3.0) and min(mixing.repetitions(counts, shares, None)) == pytest.approx(1.0)
    assert mixing.solve_exponent(counts, max_repetition=1e9) == 0.0
    assert mixing.solve_exponent(counts, target_entropy=0.0) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="target"):
        mixing.solve_exponent(counts)


def test_mixture_spends_its_budgets(spark):
    rng = random.Random(1)
    sizes = {"a": 300, "b": 60, "c": 20, None: 10}
    rows = [(rng.randrange(10**6), " ".join(["w"] * rng.randint(0, 20)) or None, s) for s, n in sizes.items() for _ in range(n)]
    got = mixing.mix_sources(frame(spark, rows), max_repetition=2.5).collect()
    own = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    shares = mixing.weights(list(own.values()), mixing.solve_exponent(list(own.values()), max_repetition=2.5))
    wanted = dict(zip(sizes, mixing.repetitions(list(own.values()), shares, None)))
    for source in sizes:
        epochs = Counter(r["epoch"] for r in got if r["source"] == source)
        whole = int(wanted[source] + 1e-9)
        assert all(epochs[e] == sizes[source] for e in range(whole))
        spent = sum(r["n_tokens"] for r in got if r["source"] == source)
        assert wanted[source] * own[source] - 21 <= spent <= wanted[source] * own[source] + 1e-3
    assert mixing.mix_sources(frame(spark, rows).limit(0), max_repetition=2.0).isEmpty()
    assert mixing.mix_sources(frame(spark, [(1, None, "s"), (2, "", None)]), max_repetition=2.0).count() == 2


def test_mixture_against_brute_force(spark, monkeypatch):
    """Which rows are taken, and that each stretch has its weights, whatever the number of slices."""
    rng = random.Random(3)
    sizes = {"a": 2600, "b": 700, "c": 41}
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)) or None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = frame(spark, rows).selectExpr("*", "'x' as epoch", "0 as position")
    own = [sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes]
    times = dict(zip(sizes, mixing.repetitions(own, mixing.weights(own, mixing.solve_exponent(own, max_repetition=1.7)), None)))
    orders = {e: {r[0]: r[1] for r in docs.select("doc_id", mixing._order("doc_id", "text", F.lit(e).cast("long"))).collect()} for e in range(2)}
    expected = set()
    for (source, r), tokens_of in zip(times.items(), own):
        whole = int(r + 1e-9)
        cut, spent = int((r - whole) * tokens_of + 1e-6), 0
        mine = [(i, len((t or "").split())) for i, t, x in rows if x == source]
        expected |= {(i, e) for i, _ in mine for e in range(whole)}
        for i, n in sorted(mine, key=lambda m: (orders[whole][m[0]], m)) if cut else ():
            spent += n
            if spent > cut:
                break
            expected.add((i, whole))
    usual = mixing.slice_bits
    for bits in (usual, lambda n: F.lit(0), lambda n: usual(n) + 5):
        monkeypatch.setattr(mixing, "slice_bits", bits)
        got = mixing.mix_sources(docs, max_repetition=1.7)
        assert got.columns == [*docs.columns[:-2], "n_tokens", "epoch", "position"]
        got = got.collect()
        assert len(got) == len(expected) and {(r["doc_id"], r["epoch"]) for r in got} == expected
        for part in range(4):
            stretch = [r for r in got if part / 4 <= r["position"] < (part + 1) / 4]
            share = sum(r["n_tokens"] for r in stretch if r["source"] == "b") / sum(r["n_tokens"] for r in stretch)
            assert share == pytest.approx(times["b"] * own[1] / sum(times[s] * t for s, t in zip(sizes, own)), abs=0.03)


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 700}") for i in range(2100)]
    got = mixing.mix_sources(frame(spark, rows), target_entropy=6.0).groupBy("source").count()
    assert got.count() == 700


def test_other_tokenizers_are_counted_by_their_library():
    import public_tokenizers
    import sentencepiece

    assert tokens.is_known_kind(tokenizer_path())
    texts = ["", "Some  text, it's 42 words!", "ßtraße <|endoftext|> </s>", "a\nb"]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        assert not tokens.is_known_kind(path) and not tokens.whole_tokens(path)
        count = tokens.make_counter(path, tokens.whole_tokens(path))
        if name.endswith(".json"):
            want = [len(tokens.load_tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]
        else:
            want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
        assert [count(t) for t in texts] == want


def test_token_counts_match_the_library(spark):
    path = tokenizer_path()
    rng = random.Random(6)
    alphabet = [*"abcXYZ é'ß\t\n\x1c\x85\u00a0!?#-_“Σς中😀İſ", "'ll", "the ", "<|endoftext|>", "<|startoftext|>", "half", "\u0301"]
    texts = [None, "", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)), "word " * 60_000]
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), path).collect()}
    library = tokens.load_tokenizer(path)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(tokens.whole_tokens(path))[::500])


def labelled(spark, n=700):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), "vileness" + rng.choice(["", "es", "like"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    return frame(spark, rows + [(None, None, "s"), (n, "", "s"), (n, "", "s")]), spark.createDataFrame(labels, LABELS)


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    used = toxicity.training_rows(docs, labels)
    assert used and all(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in used)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(701) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held if r["doc_id"] < 700]
    assert np.mean(right) > 0.9
    flagged = {r["doc_id"] for r in got if r["toxic"]}
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {r["doc_id"] for r in got} - flagged
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_documents(docs, blank).where("toxic").isEmpty()


def test_training_rows_are_bounded(spark):
    docs = frame(spark, [(i % 30, f"text {i % 30 if i < 60 else i}", "web") for i in range(400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], LABELS)
    got = toxicity.training_rows(docs, labels, 10)
    assert len(got) == 10 == len({r[0] for r in got}) and all(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in got)
    wanted = {i: min(f"text {j % 30 if j < 60 else j}" for j in range(400) if j % 30 == i) for i in range(30)}
    assert all(r[1] == wanted[r[0]] and r[3] == r[0] % 2 for r in got)


def test_score_does_not_depend_on_chunks():
    model = toxicity.train(["a b c"] * 20 + ["bad thing"] * 20, [0] * 20 + [1] * 20, ["en"] * 40)
    score = toxicity.Scorer(model)
    long = " ".join(["a b c"] * 5000)
    assert score(long + " bad thing") == pytest.approx(score("a b c a b c bad thing"), abs=1e-6)


def test_score_against_a_plain_model():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["fine", "good", "day", "awful", "curse"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    model = toxicity.train(texts, [int("awful curse" in t) for t in texts], ["en"] * 80)
    score = toxicity.Scorer(model)
    for text in [*texts[:20], "", "unseen words of every kind", "ß \u2028 x"]:
        vectors = [np.mean([model.table[r] for r in toxicity.word_rows(w)], axis=0) for w in text.split()]
        vectors += [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        pooled = []
        for weights in model.filters:
            found = [sum(vectors[p + k] @ weights[k] for k in range(len(weights))) for p in range(len(vectors) - max(toxicity.WIDTHS) + 1)]
            pooled.append(np.max(found, axis=0))
        z = float(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out) + model.out_bias
        a, b = model.scale
        assert score(text) == pytest.approx(1 / (1 + np.exp(-(a * z + b))), abs=1e-4)


def test_log_ratio_and_threshold_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh"[: 4 + 4 * (i % 3 == 0)]) * rng.randint(1, 4) for _ in range(rng.randint(12, 40))) for i in range(240)] + [None, "abc"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    marks = {i: int(i % 3 != 0) for i in range(0, 240, 2)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], LABELS)
    aside = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.ASIDE)) == 0).select("doc_id").collect()}
    grams = [quality.gram_buckets((t or "").encode()).tolist() for t in texts]
    raw, trusted = Counter(), Counter()
    for i, found in enumerate(grams):
        raw.update(found)
        if marks.get(i) and i not in aside:
            trusted.update(found)
    cells = 1 << quality.BITS

    def share(counts, bucket):
        return (counts[bucket] + 0.5) / (sum(counts.values()) + 0.5 * cells)

    ratio = {b: np.log(share(trusted, b)) - np.log(share(raw, b)) for b in raw}
    scores = [np.mean([ratio[b] for b in found]) if found else 0.0 for found in grams]
    got = {r["doc_id"]: r for r in quality.judge_quality(docs, labels).collect()}
    sound = [i for i in marks if not got[i]["base_failed"]]
    low = np.percentile([scores[i] for i in sound if marks[i] and i in aside], 100 * (1 - quality.KEEP_TRUSTED))
    high = np.percentile([scores[i] for i in sound if not marks[i]], 100 * quality.KEEP_TRUSTED)
    cut = (low + high) / 2 if high < low else low
    for i, row in got.items():
        assert row["score"] == pytest.approx(scores[i], abs=1e-9)
        assert row["kept"] == (not row["base_failed"] and scores[i] >= cut) or abs(scores[i] - cut) < 1e-9


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefg") for _ in range(40)) for _ in range(300)]
    junk = [" ".join(rng.choice(["$$%%", "##&&", "<<>>"]) + rng.choice("abcdefg") for _ in range(40)) for _ in range(30)]
    texts = [*good, *junk, None, "", "x\nx\n\n \n x", "a b c d e f a b c d e g h i j k l", "é " * 30]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 330, 2)], LABELS)
    got = {r["doc_id"]: r for r in quality.judge_quality(docs, labels).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        row = got[i]
        assert (row["n_words"], row["word_chars"]) == (len(words), sum(len(w.decode()) for w in words))
        assert row["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == brute_repeats(words)
        assert row["base_failed"] == (len(words) < 10 or 100 * row["n_repeat_words"] > 20 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert np.mean([got[i]["kept"] for i in range(300)]) > 0.98 and not any(got[i]["kept"] for i in range(300, 330))
    assert all(r["kept"] != r["base_failed"] for r in quality.judge_quality(docs, labels.limit(0)).collect())
    assert quality.judge_quality(docs.limit(0), labels).isEmpty()


PAGES = "page_id long, url string, html string, host string"
BAD = "<html><head><title>no</title><script>var a='</p>';</script></head><body><nav><li>menu<li>more</nav><div class='top-ad'>buy</div>"


def test_article_text():
    page = BAD + "<article><h1>Head &amp; line</h1><p>a <b>b\n c<br>d<p>e&nbsp;f&lt;<form>no</form><div class=comments>x</div><ul><li>1<li>2</ul>tail</article><footer>f"
    assert html_extract.main_text(page) == "Head & line\n\na b c d\n\ne f<\n\n1\n\n2\n\ntail"
    assert html_extract.main_text("") == "" and html_extract.main_text("<p") == "" and html_extract.main_text("a < b &amp c") == "a < b & c"
    assert html_extract.main_text("<!-- x --><div" + " a" * 9 + ">t</div><style>s</style>") == "t"
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert html_extract.main_text(deep) == "core"


def test_tree_matching():
    shape = html_extract.parse("<div><h1>a</h1><p>b</p><span>c</span></div>").shape()
    other = html_extract.parse("<div><p>x</p><em>y</em><span>z</span></div>").shape()
    mapped = html_extract.simple_tree_matching(shape, other)
    assert mapped == (0, 1, -1, 2, 4) and html_extract.simple_tree_matching(shape, shape) == (0, 1, 2, 3, 4)


def test_wrappers_drop_constant_slots(spark):
    rows = [(i, f"http://a.net/{i}", f"<body><div>Site name</div><section><p>Text {i}</p></section><em>All rights</em></body>", "h") for i in range(5)]
    rows += [(9, "http://b.net/", "<body><div>Site name</div><p>Alone</p></body>", "h"), (10, None, "<p>No host</p>", "h"), (11, "http://a.net/", None, "h"), (11, "http://a.net/", None, "h")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_text(spark.createDataFrame(rows, PAGES)).collect())
    assert got[:5] == [(i, f"Text {i}", 6) for i in range(5)]
    assert got[5:] == [(9, "Site name\n\nAlone", 16), (10, "No host", 7), (11, "", 0), (11, "", 0)]
    assert html_extract.extract_text(spark.createDataFrame([], PAGES)).isEmpty()
