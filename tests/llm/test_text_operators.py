"""Edge cases and brute-force versions of the operators that look at one text at a time."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadmill.llm import chat_format, decontamination, html_blocks, html_extract, html_pages, packing, quality_rules, token_counts, toxicity
from leadmill.llm.html_blocks import leaf_blocks
from leadmill.llm.html_crf import decode


def test_main_text_of_pages(spark):
    html = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>One <b>two</b>three.<br>Four&nbsp;five<p>Last one stands here.</article>"
        "<section class='comments'><p>I say so.</p></section><form><p>Your name</p></form><footer>&copy; me</footer>"
    )
    rows = spark.createDataFrame([(1, "u", html, 1), (2, None, None, 2), (3, "u", "", 3), (None, "u", "<p", 4), (3, "u", "", 3)], "page_id long, url string, html string, n_chars int")
    found = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract(rows).collect()}
    assert found[(1, "u")][0] == "A & B One twothree. Four five Last one stands here."
    assert found[(2, None)] == ("", 0) and found[(3, "u")] == ("", 0) and found[(None, "u")] == ("", 0)
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_crf_on_held_out_pages():
    model = html_extract.trained_model()
    right = total = 0
    for blocks, labels in html_pages.labelled(60, seed=4242):
        right += sum(a == b for a, b in zip(decode(blocks, model, {}), labels))
        total += len(labels)
    assert right / total > 0.95


def test_blocks_survive_broken_markup():
    assert [b.text for b in leaf_blocks("<p>a<p>b<li>c</div></nope>d<td>e<!-- x")] == ["a", "b", "c", "d", "e"]
    assert leaf_blocks(None) == [] and leaf_blocks("<script>x") == []


def _plain_ratios(words, texts, labelled, discount=0.75):
    """Log ratios of whole words by plain counting, from the definition."""
    grams = set()
    for text in texts:
        x = ["", *(c if c.isalpha() else "" for c in (text or "").lower()), ""]
        x = [c for i, c in enumerate(x) if i == 0 or c or x[i - 1]]
        grams |= {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    chance = {}
    for n in (2, 3, 4):
        types = Counter(g[1:] for g in {g[-n - 1 :] for g in grams})
        total, kinds = Counter(), Counter()
        for g, c in types.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        for g, c in types.items():
            chance[g] = (c - discount + discount * kinds[g[:-1]] * chance.get(g[1:], 1e-3)) / total[g[:-1]]
    counts = {}
    for text, toxic in labelled:
        for word in set(re.findall(r"[^\W\d_]+", text.lower())):
            for i in range(1, len(word) + 2):
                counts.setdefault((word + "$")[:i], [0, 0])[toxic] += 1
    out = []
    for word in words:
        ratio = 0.0
        for i in range(1, len(word) + 2):
            begin = (word + "$")[:i]
            after = [v for b, v in counts.items() if len(b) == i and b[:-1] == begin[:-1]]
            gram = tuple(["", *("" if c == "$" else c for c in begin)][-4:])
            p = []
            for kind in (1, 0):
                total, kinds = sum(v[kind] for v in after), sum(v[kind] > 0 for v in after)
                left = discount * kinds / total if total else 1.0
                own = max(0.0, counts.get(begin, [0, 0])[kind] - discount) / total if total else 0.0
                p.append((left, own + left * chance.get(gram, 1e-3)))
            if begin not in counts:
                ratio += math.log(p[0][0] / p[1][0])
                break
            ratio += math.log(p[0][1] / p[1][1])
        out.append(ratio)
    return out


def test_toxicity_model_against_plain_counts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("ba", "zu", "éin", "t", "k")) for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() + rng.choice(("", ",", "7")) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "Ba"]
    labelled = [(t, int(i % 3 == 0)) for i, t in enumerate(texts[:25])]
    model = toxicity.beginnings_model(spark.createDataFrame([(t,) for t in texts + [None]], "text string"), spark.createDataFrame(labelled, "text string, toxic int"))
    words = [word() for _ in range(60)] + ["q", "zuq", "ba" * 300]
    laid = toxicity.Laid([" ".join(words)])
    assert np.allclose(model.word_ratios(laid, np.arange(len(words))), _plain_ratios(words, texts, labelled), atol=1e-5)
    ratios = dict(zip(words, _plain_ratios(words, texts, labelled)))
    features = toxicity.text_features([" ".join(words[:9]), None, words[0]], model)
    own = sorted((ratios[w] for w in set(words[:9])), reverse=True)
    assert np.allclose(features, [(sum(own) / len(own), sum(own[: toxicity.PEAK_WORDS]) / toxicity.PEAK_WORDS), (0, 0), (ratios[words[0]], ratios[words[0]] / toxicity.PEAK_WORDS)], atol=1e-5)


def test_toxicity_generalises_and_survives_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(3)
    words = ["".join(rng.choice(["ba", "co", "di", "fu", "ge", "ho"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(60)] + (["zurk" + rng.choice(words) for _ in range(3)] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (99999, 1), (5, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [i for i, r in found.items() if r.held_out]
    assert held and sum(found[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    odd = toxicity.score_documents(docs.unionByName(odd_docs.select("doc_id", "text")), marks)
    assert odd.count() == 811 and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(no_docs, marks).count() == 0
    assert toxicity.score_documents(docs, marks.where("toxic = 1")).where("score <> 0").count() == 0


def _statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "a b c ", "\n", "# ", " x ", "é", "\x0b", "\x1f"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.counts_of(text)[:5] == _statistics(text)
    assert quality_rules.counts_of(None)[:5] == (0, 0, 0, 0, 0)


def test_decision_list_learns_rules(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    x = {k: rng.random(3000) for k in quality_rules.features()}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["digit_share"] < 0.3))
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    judged = quality_rules.judge(odd_docs, labels)
    assert judged.count() == 11 and judged.where("kept is null or base_failed is null").count() == 0
    assert {r.base_failed for r in judged.where("doc_id in (1, 2, 3)").collect()} == {True}
    assert quality_rules.judge(no_docs, labels).count() == 0


def test_ranks_file_gives_the_ids_of_tokenizers():
    texts = ["", "Hello wörld  two", "a" * 300, "\n\n\t x", "😀☃", "<|endoftext|> end", "it's 1234 DON'T"]
    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))(texts)
    slow = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts)
    assert [x.tolist() for x in fast] == [x.tolist() for x in slow]


def test_encoders_give_the_ids_of_an_unmodified_tokenizer():
    texts = ["<|endoftext|> end", "a<|endoftext|><|endoftext|>b", " <|endoftext|>\n", "<|endoftext|", "<|EndOfText|>", "it's  1234 <|endoftext|>DON'T", "", "caf\u00e9 \U0001f600"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [50256, 886]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        assert [x.tolist() for x in packing.encoder(public_tokenizers.path(name))(texts)] == expected


def test_packing_is_gapless_and_keeps_the_mixture(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r.asDict() for r in packing.pack(odd_docs, path).collect()]
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in rows:
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["offset"] + r["length"] <= 1024
        at += r["length"]
    assert at == sum(len(x) + 1 for x in packing.encoder(path)([r.text or "" for r in odd_docs.collect()]))
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1]
    assert packing.pack(no_docs, path).count() == 0


def test_rounds_keep_every_window_near_the_targets():
    lengths = [400_000, 120_000, 9_000]
    for weights in (None, [0.2, 0.5, 0.3]):
        rounds = packing.Rounds(lengths, weights or [n / sum(lengths) for n in lengths], 1024, 128)
        queue, start, n = [], [], []
        for q, length in enumerate(lengths):
            for low in range(0, length, 777):
                queue.append(q), start.append(low), n.append(min(777, length - low))
        queue, start, n = map(np.array, (queue, start, n))
        row, first, length, at = packing.place_pieces(rounds, queue, start, n)
        order = np.argsort(at)
        assert (at[order][1:] == (at + length)[order][:-1]).all() and at.min() == 0 and (at + length).max() == sum(lengths)
        assert (np.bincount(row, length) == n).all()
        window = np.zeros((at.max() // 1024 + 1, 3))
        np.add.at(window, (at // 1024, queue[row]), length)
        if weights is None:
            assert (np.abs(window[:-3] - 1024 * np.array(lengths) / sum(lengths)) <= 2 * 128).all()


def test_rounds_against_a_plain_deficit_round_robin():
    rng = random.Random(6)
    for _ in range(20):
        lengths = [rng.randint(1, 40_000) for _ in range(rng.randint(1, 6))]
        total, grain, window = sum(lengths), 128, 1024
        rounds = packing.Rounds(lengths, [n / total for n in lengths], window, grain)
        deficit, done, want, at = [Fraction(0)] * len(lengths), [0] * len(lengths), [], 0
        for w in range(rounds.last + 1):
            for q, n in enumerate(lengths):
                deficit[q] += Fraction(window * n, total)
                while done[q] < n and (w == rounds.last or deficit[q] >= grain and done[q] + grain <= n):
                    size = min(grain, n - done[q])
                    want.append((q, done[q], size, at))
                    deficit[q], done[q], at = deficit[q] - grain, done[q] + size, at + size
        queue = np.arange(len(lengths))
        row, first, length, at = packing.served(rounds, queue, np.zeros(len(lengths), dtype=np.int64), np.array(lengths))
        assert sorted(zip(row.tolist(), first.tolist(), length.tolist(), at.tolist())) == sorted(want)


def test_packing_of_more_sources_than_lanes(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(i, f"text {i} " * (i % 90), None if i % 7 == 0 else f"s{i % 7}") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    ids = {i: [*x.tolist(), 0] for (i, _, _), x in zip(docs, packing.encoder(path)([t for _, t, _ in docs]))}
    share = Counter()
    for i, _, source in docs:
        share[source] += len(ids[i]) / sum(map(len, ids.values()))
    for lanes, targets in ((1, None), (2, None), (2, {"s3": 0.5, "none": 0.2})):
        monkeypatch.setattr(packing, "LANES", lanes)
        rows = packing.pack(frame, path, targets=targets).collect()
        rows.sort(key=lambda r: (r.sequence_id, r.offset))
        at, seen, windows = 0, {i: 0 for i in ids}, Counter()
        for r in rows:
            assert r.sequence_id * 1024 + r.offset == at and r.offset + r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
            assert r.source == docs[r.doc_id][2] and r.doc_tokens == len(ids[r.doc_id])
            at, seen[r.doc_id] = at + r.length, seen[r.doc_id] + r.length
            windows[r.sequence_id, r.source] += r.length
        assert seen == {i: len(x) for i, x in ids.items()}
        if targets is None:
            assert all(abs(windows[w, s] - 1024 * p) <= 4 * 128 for w in range(at // 1024 - 3) for s, p in share.items())
        else:
            assert all(abs(windows[w, "s3"] - 1024 * 0.5 / (0.5 + 1 - share["s3"])) <= 2 * 128 for w in range(5))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "<~|", "<~~~|~<s>", "", None, "a[INST]<~s>", "é😀\n", "<|end", "[[/INST]]<<SYS>>"]
    rows = [(i, t, role, text) for i, text in enumerate(texts) for t, role in ((0, "system"), (1, "user"), (2, "assistant"), (2, "assistant"), (3, None))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(turns.withColumn("parts", chat_format.text_parts(F.col("text"))).withColumn("flat", F.lit(1)))
    for r in chat_format.read_back(chats).collect():
        text = texts[r.conv_id] or ""
        assert sorted((t.role, t.text) for t in r.turns) == sorted([("", text), ("assistant", text), ("assistant", text), ("system", text), ("user", text)])
        assert r.loss_text == text * 2
    for r in chats.collect():
        assert r.formatted.count("<|end|>") == 5 and "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat_format.format_chats(turns.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "i.png", 2), ("text", " and <|image|>", None, None), ("audio", None, "a.wav", 3), ("file", None, "d.pdf", None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART.simpleString()}>")
    r = chat_format.format_chats(turns).first()
    assert "see <|image|> and <~|image|><|audio|><|document|><|end|>" in r.formatted
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 512), (1, "audio", "a.wav", 75), (2, "document", "d.pdf", 512)]
    assert r.attachment_tokens == 1099 and [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["ok"]


def _pieces(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in scores and best[start][0] + scores[word[start:end]] > best[end][0]:
                best[end] = (best[start][0] + scores[word[start:end]], best[start][1] + 1)
        if word[end - 1] not in scores:
            size = len(word[end - 1].encode())
            if best[end - 1][0] + size * token_counts.BYTE_SCORE > best[end][0]:
                best[end] = (best[end - 1][0] + size * token_counts.BYTE_SCORE, best[end - 1][1] + size)
    return best[-1][1]


def test_token_counts_against_plain_viterbi(spark, odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    rows = {(r.doc_id): r for r in token_counts.count_tokens(odd_docs, path).collect()}
    for r in odd_docs.where("doc_id in (1, 2, 3, 6, 7, 9) or doc_id is null").collect():
        words = (r.text or "").split()
        assert (rows[r.doc_id].n_pretokens, rows[r.doc_id].n_tokens) == (len(words), sum(_pieces("▁" + w, scores) for w in words))
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_trie_forgets_without_changing_counts(monkeypatch):
    scores = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.2, "▁ab": -1.5, "ba": -1.4}
    monkeypatch.setattr(token_counts, "MOST_NODES", 8)
    trie = token_counts.Trie(scores)
    rng = random.Random(0)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        assert trie.count(word) == _pieces(word, scores)


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((40, 25, 12, 6, 3))] + [(9, None), (10, ""), (None, "x")]
    filler = lambda: " ".join(word() for _ in range(150))
    docs, want = [], {}
    for i, text in items[:5]:
        docs.append((i, f"{filler()} {text.upper()}. {filler()}"))
        want[i] = i < 4
    changed = items[0][1].split()
    for at in (3, 12, 22, 33):
        changed[at] = "zzz"
    docs += [(20, f"{filler()}\n{' '.join(changed)}"), (21, filler()), (22, None), (23, ""), (24, " ".join(items[0][1].split()[:8]))]
    want |= {20: True, 21: False, 22: False, 23: False, 24: False}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(table, benchmark).collect()}
    assert {i: r.contaminated for i, r in found.items()} == want and found[20].item_id == 0 and found[0].n_same == 40
    assert decontamination.contamination(odd_docs, benchmark).where("contaminated").count() == 0
    assert decontamination.contamination(odd_docs, benchmark.limit(0)).count() == 11
    assert decontamination.contamination(no_docs, benchmark).count() == 0


def test_very_long_words_count_the_same_without_the_trie():
    rng = random.Random(9)
    trie = token_counts.Trie({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): -rng.random() * 9 for _ in range(30)} | {"▁": -1.0})
    for n in (1, 2, 7, 60, 400):
        word = "▁" + "".join(rng.choice("abcé") for _ in range(n))
        assert trie.count_alone(word) == trie.count(word)
    assert trie.count("▁" + "ab" * 20_000) > 0 and len(trie.best) < 1000


def test_encoders_agree_on_whole_texts(sf_dir):
    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()]
    rng = random.Random(13)
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700), 10, 32, 160))) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    fast, plain = (packing.encoder(public_tokenizers.path(f"byte_bpe_50k.{kind}"))(texts) for kind in ("tiktoken", "json"))
    assert all(a.tolist() == b.tolist() for a, b in zip(fast, plain, strict=True))


def _plain_overlap(text, item):
    """Equal tokens of the best aligned stretch that is long and similar enough, by trying every one."""
    x, y = decontamination.tokens_of(text), decontamination.tokens_of(item)
    if len(y) < decontamination.LEAST_TOKENS:
        return 0
    need, share = min(decontamination.STRETCH, len(y)), 1 if len(y) <= decontamination.WHOLE else decontamination.LEAST_SAME
    best = 0
    for start in range(need - len(y), len(x) - need + 1):
        same = [0 <= start + i < len(x) and x[start + i] == y[i] for i in range(len(y))]
        low, high = max(0, -start), min(len(y), len(x) - start)
        for i in range(low, high):
            for j in range(i + need, high + 1):
                if sum(same[i:j]) >= share * (j - i):
                    best = max(best, sum(same[i:j]))
    return best


def test_decontamination_against_trying_every_alignment(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((16, 17, 22, 30, 9, 12, 15, 6, 8, 4, 16))]
    docs = [(None, "w1 w2"), (3, None), (3, "")]
    for i in range(120):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, len(copy) // 3)):
            copy[rng.randrange(len(copy))] = word()
        copy = copy[rng.randint(0, 3) :]
        docs.append((i // 2 if i % 9 else None, " ".join([word() for _ in range(rng.randint(0, 12))] + copy + [word() for _ in range(rng.randint(0, 12))])))
    benchmark, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs + docs[-3:], "doc_id long, text string")
    want = []
    for doc_id, text in docs + docs[-3:]:
        found = [n for n in (_plain_overlap(text, item) for _, item in items) if n]
        want.append((doc_id, bool(found), len(found)))
    for most in (decontamination.BLOCK_TOKENS, 40):
        monkeypatch.setattr(decontamination, "BLOCK_TOKENS", most)
        rows = decontamination.contamination(table, benchmark).collect()
        assert Counter((r.doc_id, r.contaminated, r.n_items) for r in rows) == Counter(want)
        shown = Counter((r.doc_id, r.item_id, r.n_same) for r in rows)
        assert most == 40 and shown == before or most != 40
        before = shown
    assert sum(c for _, c, _ in want) > 30


def test_masks_hit_whatever_tokens_are_replaced():
    def missed(n, masks):
        left = np.array([(1 << n) - 1 - sum(1 << i for i in gone) for gone in combinations(range(n), n // 4)], dtype=np.uint32)
        for mask in masks:
            bits = np.uint32(int(mask, 2))
            for shift in range(n - len(mask) + 1):
                left = left[(left >> np.uint32(shift)) & bits != bits]
        return len(left)

    # A stretch of other lengths from STRETCH on holds one of these that is as alike.
    assert [missed(n, decontamination.MASKS) for n in (16, 20, 24)] == [0, 0, 0]
    assert [missed(n, decontamination.SHORT_MASKS) for n in range(9, 16)] == [0] * 7


def test_hash_of_kept_bytes_is_plain_sha():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_hostile_markup_is_read_in_linear_time():
    began = time.perf_counter()
    for page in ('<a "' * 262_144, '<a "' * 262_145 + ">", "<p a='\"" * 150_000 + ">", "<" * 1_000_000, "</script " * 100_000, "<b x=" * 200_000 + "'>"):
        html_blocks.leaf_blocks(page)
    assert time.perf_counter() - began < 4


def test_ends_of_pages_that_stop_anywhere():
    read = lambda page: [b.text for b in html_blocks.leaf_blocks(page)]
    assert read("<p>one</p>two <!-- three") == ["one", "two"]
    assert read("<p>one</p>two <script src") == ["one", "two"]
    assert read("<p>one</p>two < three <b") == ["one", "two < three <b"]
    assert read('<p title="a > b">one</p>') == ["one"]
    assert read("<p title='>one</p><p>two</p>") == ["one", "two"]
