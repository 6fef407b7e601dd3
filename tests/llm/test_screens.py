import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import ITEMS, frame, rows, sha, words

from logsift.llm import decontam, lm, quality, secrets, toxicity


# ---------------------------------------------------------------- quality rules

def brute_counts(text):
    t = text or ""
    w = words(t)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    in_repeat = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(w), len(re.sub(r"[\x20\x09-\x0D]", "", t)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(in_repeat))


def test_quality_counts_and_base_rule(spark):
    got = quality.quality_verdicts(frame(spark)).collect()
    by_id = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        n, chars, symbols, lines, rep = brute_counts(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, rep)
        failed = n < 50 or 100 * rep > 50 * n
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
    assert quality.quality_verdicts(frame(spark, [])).count() == 0


def test_fences_follow_the_source(spark):
    def doc(i, source, text):
        return (i, text, "en", source, 0, "", 0, "")
    body = [" ".join(f"w{(i * 7 + j * 13) % 997}x" for j in range(80)) for i in range(150)]
    data = [doc(i, "plain", b) for i, b in enumerate(body)] + [doc(1000 + i, "symbols", b.replace(" ", " # ")) for i, b in enumerate(body)]
    odd = [doc(5000, "plain", body[0].replace(" ", " # ")), doc(5001, "symbols", body[1].replace(" ", " # "))]
    rows_ = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(frame(spark, data + odd)).collect()}
    assert all(rows_[d[0]] for d in data)
    assert rows_[5000] is False and rows_[5001] is True       # the same text shape, judged by its own source
    kept = quality.keep_good(frame(spark, data + odd))
    assert kept.columns == frame(spark).columns and kept.count() == len(data) + 1


def test_upper_fences_follow_a_source_with_some_symbols(spark):
    def doc(i, text):
        return (i, text, "en", "mixed", 0, "", 0, "")
    words_ = lambda i: [f"w{(i * 7 + j * 13) % 997}x" for j in range(80)]
    # 30 % code-like texts (200 to 500 symbols in 1,000 words of the same lengths), and one far beyond them
    data = [doc(i, " ".join("#" * (i % 10 < 3 and j < 16 + i % 25) + w[i % 10 < 3 and j < 16 + i % 25:] for j, w in enumerate(words_(i))))
            for i in range(300)]
    odd = doc(5000, " ".join("##" + w[2:] + "x" for w in words_(1)))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(frame(spark, [*data, odd])).collect()}
    assert all(kept[d[0]] for d in data) and kept[5000] is False
    assert quality.keep_good(frame(spark, [*data, odd])).count() == len(data)


# ---------------------------------------------------------------- secrets

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_spans(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    got = secrets.secret_report(frame(spark)).collect()
    assert len(got) == len(rows())
    by_id = {r[0]: r[1] for r in rows()}
    some = 0
    for r in got:
        want = brute_spans(by_id[r["doc_id"]])
        some += len(want)
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == sha(listed.encode())
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert some >= 4
    assert secrets.secret_report(frame(spark, [])).count() == 0


def test_copied_examples_are_told_from_live_values(spark):
    live, example = "Q7zR2mK9xW4vB8nT6yLp3s", "EXAMPLEkey0000example00"
    data = [(i, f"see {example} here", "en", f"owner{i}", 0, "", 0, "") for i in range(6)]
    data += [(10, f"my {live} é {live} {example}", "en", "me", 0, "", 0, ""), (11, f"fork {live}", "en", "me", 0, "", 0, "")]
    got = {r["doc_id"]: r for r in secrets.secret_report(frame(spark, data)).collect()}
    assert got[0]["spans"] == "" and got[0]["n_example"] == 1
    assert got[10]["spans"] == "mixed:3:25,mixed:28:50" and got[10]["n_live"] == 2
    red = {r["doc_id"]: r for r in secrets.redact(frame(spark, data)).collect()}
    assert red[10]["text"] == f"my <SECRET> é <SECRET> {example}" and red[10]["n_chars"] == len(red[10]["text"])
    assert red[0]["text"] == data[0][1] and red[0]["n_chars"] == 0 and len(red) == len(data)


def test_a_value_in_many_documents_of_one_source_is_a_copied_example(spark):
    live, pasted = "Q7zR2mK9xW4vB8nT6yLp3s", "Paste0Your1Own2Key3Here4"
    data = [(i, f"see {pasted} here", "en", "hot", 0, "", 0, "") for i in range(2000)]
    data += [(3000 + i, f"fork {live}", "en", "hot", 0, "", 0, "") for i in range(5)]
    got = {r["doc_id"]: r for r in secrets.secret_report(frame(spark, data)).collect()}
    assert all((r["n_live"], r["n_example"], r["spans"]) == ((1, 0, "mixed:5:27") if d >= 3000 else (0, 1, "")) for d, r in got.items())
    red = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, data)).collect()}
    assert all(red[d[0]] == ("fork <SECRET>" if d[0] >= 3000 else d[1]) for d in data)


def test_redact_keeps_clashing_columns_and_missing_ids(spark):
    names = ("_m", "_spans", "_text_hash", "row", "spans", "doc", "hits", "text_", "value")
    data = [(1, "key password=hunter22 end", "s", 5, *names), (None, "token=abc123xyz789", None, None, *names),
            (None, None, None, None, *names), (1, "key password=hunter22 end", "s", 5, *names)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    got = secrets.redact(df)
    assert got.columns == df.columns
    want = [(1, "key <SECRET> end", "s", 16, *names)] * 2 + [(None, "<SECRET>", None, 8, *names), (None, None, None, None, *names)]
    fix = lambda rows: sorted(str(tuple(r)).replace("key password=<SECRET>", "key <SECRET>") for r in rows)
    assert fix(got.collect()) == fix(want)


# ---------------------------------------------------------------- decontamination

def edit_search(pattern, text):
    """Least edit distance of the pattern to any substring, by rows."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_matches_the_plain_recurrence():
    import random
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        want = edit_search(p, t)
        limit = len(p) // 3
        assert decontam.myers(decontam.peq(p), len(p), t, limit) == (want if want <= limit and want < len(p) else limit + 1)


def test_contaminated_matches_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contaminated(frame(spark), bench, block_chars=60).collect())
    want = []
    for r in rows():
        t = decontam.normal(r[1])
        if len(t) > 5000:
            continue
        for item_id, item in ITEMS:
            item = decontam.normal(item)
            if item:
                d = edit_search(item, t)
                if d <= decontam.budget(len(item), 0.06, 40):
                    want.append((r[0], item_id, d, len(item)))
    assert got == sorted(want) and len(want) >= 2
    clean = decontam.keep_clean(frame(spark), bench)
    hit = {x[0] for x in want}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in rows() if r[0] not in hit)
    assert decontam.contaminated(frame(spark), bench.limit(0)).count() == 0
    assert decontam.contaminated(frame(spark, []), bench).count() == 0


# ---------------------------------------------------------------- LM scoring

def test_baseline_counts_match_brute_force(spark):
    got = lm.lm_scores(frame(spark), top_words=20).collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [w.lower() for w in words(t)] + [b""]
    c = Counter(w for r in rows() if not out(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    by_id = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        t = tokens(by_id[r["doc_id"]])
        assert r["held_out"] == out(r["doc_id"]) and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in c for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm.lm_scores(frame(spark, [])).count() == 0


def random_model(words, bits=10):
    rng = np.random.default_rng(1)
    model = lm.untuned(lm.Speller(words, sum(words.values()) + 9), (bits,) * lm.ORDERS,
                       [rng.integers(-30000, 30000, 1 << bits).astype(np.int16) for _ in range(lm.ORDERS)])
    model["weights"] = rng.normal(0.3, 0.2, (lm.ORDERS + 1, lm.GATES)).astype(np.float32)
    model["spent"] = lm.spent_table(model["map"])
    return model


def test_probabilities_of_all_next_symbols_add_up_to_one():
    words = {f"w{i}".encode(): 40 + i for i in range(70)} | {b"seldom": 1}
    model = random_model(words)
    speller = model["speller"]
    assert math.isclose(sum(2.0 ** -int(n) for n in speller.length[:256]), 1.0)
    assert math.isclose(sum(2.0 ** -int(n) for n in speller.length[256:]), 1.0)

    def spent(texts, nth):
        """Probability of the nth symbol of each text."""
        sp = lm.Spelled(texts, speller)
        each = np.zeros(len(sp.at))
        for d, (n, slots, bit) in enumerate(sp.decisions(model["bits"])):
            _, z, _ = lm.mixed(model, sp, n, slots)
            at = (sp.rows(d, n) + bit * lm.PLACES) * 24 * lm.STEPS + np.floor(z * lm.STEPS).astype(int) + 12 * lm.STEPS
            each[:n] += model["spent"][at]
        by_place = np.empty_like(each)
        by_place[sp.order] = each
        first = np.flatnonzero(np.diff(sp.ends, prepend=-1))
        return 10.0 ** by_place[first + nth]

    coded = [w for w, n in words.items() if n >= 4]
    assert len(coded) == speller.coded
    assert math.isclose(spent(coded + [b"unknown", b""], 0).sum(), 1.0, rel_tol=1e-4)
    after_escape = [bytes([b]) + b"q" for b in range(256) if b != 32] + [b" q"]
    assert math.isclose(spent(after_escape, 1).sum(), 1.0, rel_tol=1e-4)


def test_score_does_not_depend_on_neighbours():
    docs = [lm.spelling((r[1] or "").encode()) for r in rows()][:40]
    model = random_model(dict(Counter(w for d in docs for w in d.split()).most_common(50)), 12)
    score = lambda texts: lm.log10_probabilities(lm.Spelled(texts, model["speller"]), model)
    assert np.allclose(score(docs), [score([d])[0] for d in docs])


def test_symbols_give_the_text_back():
    docs = [lm.spelling((r[1] or "").encode()) for r in rows()][:40] + [b"\xff\xfe odd \x00 bytes"]
    for words in ({}, dict(Counter(w for d in docs for w in d.split()).most_common(60)) | {b"": 40}):
        speller = lm.Speller(words, 1000)
        ranked = list(speller.ids)
        sp = lm.Spelled(docs, speller)
        for i, d in enumerate(docs):
            syms = sp.data[np.sort(sp.at)][sp.ends == i].tolist()
            assert syms[-1] == lm.END and lm.END not in syms[:-1]
            out, spelled = [], None
            for s in syms[:-1]:
                if s >= lm.FIRST:
                    out.append(ranked[s - lm.FIRST])
                elif s == lm.ESCAPE:
                    spelled = b""
                elif s == 32:
                    out.append(spelled)
                else:
                    spelled += bytes([s])
            assert b" ".join(out) == d


def test_words_are_looked_up_together_as_a_dictionary_would():
    import pickle
    rng = np.random.default_rng(4)
    odd = [b"", b"\0", b"\0\0", b"a", b"a\0", b"\xff" * 15, *(b"a" * n for n in (7, 8, 9, 14, 15, 16, 17, 300))]
    drawn = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 24, 3000)]
    asked = odd + drawn + [w + b"\0" for w in odd + drawn[:500]]
    buffer, width = b" ".join(asked) + b" ", np.array([len(w) for w in asked])
    start = np.cumsum(width + 1) - width - 1
    for known in ([], [b""], list(dict.fromkeys(odd[::2] + drawn[::3])), list(dict.fromkeys(odd[1::2] + drawn))):
        rank = {w: i for i, w in enumerate(known)}
        places = pickle.loads(pickle.dumps(lm.Places(known)))
        assert places.find(buffer, start, width).tolist() == [rank.get(w, -1) for w in asked]
    # tasks get the numbers alone, not a dictionary of all words
    speller = lm.Speller({w: 1 + i for i, w in enumerate(dict.fromkeys(odd + drawn)) if w}, 10_000)
    assert not any(isinstance(v, dict) for v in vars(pickle.loads(pickle.dumps(speller))).values())


def test_unknown_words_are_counted_text_by_text():
    texts = [b"", b"new old new", b"old", b"new " + b"n" * 40, b"new a\0 a"]
    sp = lm.Spelled(texts, lm.Speller({b"old": 9, b"": 5}, 14))
    got = lm.unknown_words(sp, np.repeat(np.arange(len(texts)), sp.sizes)).to_pylist()
    want = [[], [(b"new", 2)], [], [(b"new", 1), (b"n" * 40, 1)], [(b"new", 1), (b"a\0", 1), (b"a", 1)]]
    assert [[(r["token"], r["k"]) for r in rare] for rare in got] == want


def test_counts_spell_a_repeated_context_and_symbol_once(monkeypatch):
    docs = [lm.spelling((r[1] or "").encode()) for r in rows()][:30] + [b""]
    speller = lm.Speller(dict(Counter(w for d in docs for w in d.split()).most_common(60)) | {b"": 40}, 1000)
    bits, walked, whole = (12, 11, 13), [], lm.decisions

    def watched(*args):
        for n, slots, bit in whole(*args):
            walked.append(n)
            yield n, slots, bit

    monkeypatch.setattr(lm, "decisions", watched)
    want = [np.zeros(2 << b, np.int64) for b in bits]
    for _, slots, bit in lm.Spelled(docs, speller).decisions(bits):
        for k, s in enumerate(slots):
            np.add.at(want[k], s.astype(np.int64) * 2 + bit, 1)
    walked.clear()
    for held in (1 << 20, 5000):
        counts = lm.BitCounts(speller, bits, held)
        for _ in range(20):
            counts.add(docs)
        counts.spell()
        assert all((got == 20 * w).all() for got, w in zip(counts.total, want))
        if held == 1 << 20:
            assert sum(walked) < sum(int(w.sum()) for w in want)


def test_held_out_texts_score_better_with_more_training_text(spark):
    """Words of a small vocabulary that follow one another by rule: the
    contexts must beat the word counts on nearly every held-out text, and
    more text must not make it worse."""
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(3, 8, 200)]
    follow = rng.integers(0, 200, (200, 4))

    def text():
        w, out = int(rng.integers(200)), []
        for _ in range(80):
            out.append(vocab[w])
            w = int(follow[w, rng.integers(4)])
        return " ".join(out)

    data = [(i, text()) for i in range(700)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    means = []
    for some in ([r for r in data if held(r[0]) or r[0] % 5 == 0], data):
        got = lm.lm_scores(spark.createDataFrame(some, "doc_id long, text string")).where("held_out").collect()
        means.append(np.mean([r["score"] for r in got]))
        better = np.mean([r["score"] > r["base_score"] for r in got])
    assert better >= 0.9 and means[1] > means[0]


# ---------------------------------------------------------------- toxicity

def test_toxicity_learns_from_document_labels(spark):
    import random
    rng = random.Random(1)
    vocab = [f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}{'qrstuv'[i // 64]}" for i in range(300)]
    stems = ["vilefoo", "nastbar", "crudzip"]
    data, labels = [], []
    for i in range(700):
        sentences = [" ".join(rng.choice(vocab) for _ in range(10)) for _ in range(rng.randint(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(stems) + rng.choice(["", "ly", "er"])
        data.append((i, ". ".join(sentences) + ".", "en", "s", 0, "", 0, ""))
        labels.append((i, 1, int(toxic)))
    data += [(1000, None, "en", "s", 0, "", 0, ""), (1001, "", "en", "s", 0, "", 0, "")]
    labels += [labels[0], (2000, 1, None), (None, 0, 1)]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, data), tags).collect()}
    truth = {d: t for d, _, t in labels if d is not None}
    held = [d for d in truth if d in got and got[d]["held_out"]]
    assert {d for d in got if got[d]["held_out"]} == {d for d in got if zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(got[d]["predicted"] == truth[d] for d in held) / len(held)
    assert right >= 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    spotted = [d for d in held if truth[d] and got[d]["offending"]]
    for d in spotted:
        assert any(any(s in data[d][1][o["start"]:o["end"]] for s in stems) for o in got[d]["offending"])
    none = toxicity.toxicity(frame(spark, data[:5]), tags.limit(0)).collect()
    assert all(r["predicted"] == 0 for r in none)
    assert toxicity.toxicity(frame(spark, []), tags).count() == 0


@pytest.mark.parametrize("percent", [40, 60])
def test_toxicity_learns_where_toxic_documents_are_many(spark, percent):
    rng = random.Random(percent)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    stems = ["vilqoo", "nastzar", "crudxip"]
    data, labels = [], []
    for i in range(1000):
        sentences = [" ".join(rng.choice(vocab) for _ in range(10)) for _ in range(rng.randint(1, 8))]
        toxic = i * 37 % 100 < percent
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(stems)
        data.append((i, ". ".join(sentences) + ".", "en", "s", 0, "", 0, ""))
        labels.append((i, 1, int(toxic)))
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, data), tags).where("held_out").collect()
    truth = {d: t for d, _, t in labels}
    assert {truth[r["doc_id"]] for r in got} == {0, 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) >= 0.97

def test_equal_sentences_are_fitted_once():
    rng = random.Random(3)
    bags = [[tuple(sorted(rng.sample(range(70_000), rng.randint(1, 4)))) for _ in range(rng.randint(0, 4))] for _ in range(50)]
    bags += [[], [(0,)], [(0,), (0,)], [(0, 1)], [(0, 70_000)]]
    doc, kind, kinds = toxicity.sentences([toxicity.packed(b) for b in bags])
    assert [(i, tuple(kinds[k])) for i, k in zip(doc, kind)] == [(i, s) for i, b in enumerate(bags) for s in b]
    assert len(kinds) == len({s for b in bags for s in b})
    w, _, leak = toxicity.fit([toxicity.packed(b) for b in ([(0, 1)], [(1,), (0,)], [(1,)], [])], np.array([1, 1, 0, 0]), 2)
    assert w[0] > w[1] and 1e-4 <= leak <= 0.2
