"""Token counts, pieces, language, chat, packing and personal data against the libraries and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import language, packing, pii, queries
from lodestone.llm.chat import maximal_conversations
from lodestone.llm.language import language_of
from lodestone.llm.sentencepiece import Pieces, decode, encode, round_trip
from lodestone.llm.token_counts import counter, token_counts

ODD = [
    None, "", " ", "\n\t ", "word", "Word  word x", "a" * 5000, "ab " * 40_000, "naïve façade ÉCOLE", "日本語の文章", "<|endoftext|> x", "x<|startoftext|>y",
    "emoji 👍🏽 ok", "don't we'll it's", "1234 56-78", "same text", "same text", "▁ marks ▁", "İstanbul ΣΑΣ", "tabs\tand\r\nlines", "á é", "!!!??? ...",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, ("en", "fr", None)[k % 3], "clash", 1) for k, t in enumerate(ODD)]
    rows.append((None, "no id", "en", "clash", 2))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").drop("source")


@pytest.fixture(scope="module")
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_token_counts_on_odd_texts(odd, chunk):
    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = odd if chunk > 64 else odd.filter("length(text) < 6000 or text is null")
    found = token_counts(texts, path, chunk).collect()
    assert len(found) == texts.count()
    by_id = dict(enumerate(ODD)) | {None: "no id"}
    for r in found:
        text = by_id[r["doc_id"]] or ""
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"]) == (r["doc_id"], len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)), text[:50]


def test_token_counts_on_documents(spark, tables, documents):
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    expected = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in documents.collect()}
    found = queries.op2_token_counts(spark, tables).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in found)


def test_token_counts_of_every_character():
    """Each code point between letters, and after a letter that it may combine with, against the library."""
    path = queries.vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), counter(path)
    texts = [f"a{chr(c)} x{chr(c)}b {chr(c).upper()}'s" for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD000 or 0x17000 <= c < 0x18D00 or c >= 0x20000)]
    for k in range(0, len(texts), 8192):
        expected = [len(e.ids) for e in library.encode_batch(texts[k : k + 8192], add_special_tokens=False)]
        found = [own.total(own.chunk(t)) for t in texts[k : k + 8192]]
        assert found == expected, [t for t, a, b in zip(texts[k : k + 8192], found, expected, strict=True) if a != b][:5]


def test_chunk_maps_are_associative():
    own, rng = counter(queries.vocabulary("word_bpe_49k.json")), np.random.default_rng(3)
    text = "don't  stop <|endoftext|>it e\u0301tait 12 a<|endoftext|>b " * 20
    expected = own.total(own.chunk(text))
    for _ in range(50):
        cuts = [0, *sorted(rng.integers(0, len(text), 12).tolist()), len(text)]
        maps = [own.chunk(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert own.total(own.whole(maps)) == own.total(own.scan(maps)[-1]) == expected


def test_token_counts_of_nothing(odd):
    path = queries.vocabulary("word_bpe_49k.json")
    assert token_counts(odd.limit(0), path).count() == token_counts(odd.limit(0), path, 7).count() == 0


def test_pieces_are_the_best_segmentation():
    model = Pieces(queries.vocabulary("piece_bpe_32k.model"))
    score = {p: (s, n) for n, (p, s, k) in enumerate(zip(model.pieces, model.scores, model.kinds, strict=True)) if k in (1, 4)}
    for text in ["a short sentence", "unbelievable", "naïve", "日本", "  two  words ", "👍", "x" * 30]:
        whole = model.normalised(text)
        best = [0.0] + [-np.inf] * len(whole)
        for end in range(1, len(whole) + 1):
            for start in range(end):
                piece = whole[start:end]
                if piece in score:
                    best[end] = max(best[end], best[start] + score[piece][0])
                elif end == start + 1:
                    best[end] = max(best[end], best[start] + model.worst)
        total, ids, at = 0.0, model.encode(text), 0
        while at < len(ids):
            if ids[at] in model.byte_of:
                char = 1
                while True:
                    try:
                        bytes(model.byte_of[n] for n in ids[at : at + char]).decode()
                        break
                    except UnicodeDecodeError:
                        char += 1
                at += char
                total += model.worst
            else:
                total += model.scores[ids[at]]
                at += 1
        assert total == pytest.approx(best[-1])


def test_pieces_decode_as_the_library_does(odd, documents):
    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (odd.select("doc_id", "text"), documents.select("doc_id", "text")):
        rows = decode(encode(table, path), path).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert r["decoded"] == library.decode(r["ids"])
            if "  " not in (r["text"] or "") and (r["text"] or "") == (r["text"] or "").strip(" ") and "▁" not in (r["text"] or ""):
                assert r["decoded"] == (r["text"] or "")


def test_language_of_held_out_documents(documents):
    actual = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = language_of(documents).collect()
    assert len(rows) == len(actual)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == actual[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held) > 0


def test_language_of_odd_texts(odd):
    rows = {r["doc_id"]: r for r in language_of(odd).collect()}
    assert len(rows) == len(ODD) + 1
    for k in (0, 1, 2, 3, 14, 21):
        assert rows[k]["lang_pred"] == "und"
    assert language_of(odd.limit(0)).count() == 0


def brute_force_conversations(rows):
    logged = defaultdict(list)
    for conv, turn, role, text in rows:
        logged[conv].append((turn, role, text))
    said = {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in logged.items()}
    kept = {}
    for conv in sorted(said):
        mine = said[conv]
        if any(len(o) > len(mine) and o[: len(mine)] == mine for o in said.values()):
            continue
        if mine not in kept:
            kept[mine] = [conv, len(mine), 0]
        kept[mine][2] += 1
    return sorted(map(tuple, kept.values()))


def test_conversations_that_none_prolongs(spark, tables):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
        (4, 0, "user", "hi|a"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, 0, "user", ""),
    ]
    for given in (rows, [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        table = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
        found = maximal_conversations(table).select("conv_id", "n_turns", "n_copies").collect()
        assert sorted(map(tuple, found)) == brute_force_conversations(given)


def test_long_conversations(spark):
    """20,000 turns and its snapshots after 19,999 and 5 turns; another order of the same turns is another conversation."""
    turns = spark.range(20_000).selectExpr("id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    logs = [turns.selectExpr("1L AS conv_id", "*"), turns.filter("turn < 19999").selectExpr("2L", "*"), turns.filter("turn < 5").selectExpr("3L", "*")]
    logs.append(turns.filter("turn < 6").selectExpr("4L", "5 - turn", "role", "text"))
    table = reduce(lambda a, b: a.union(b), logs)
    found = maximal_conversations(table).select("conv_id", "n_turns", "n_copies", "rendered").collect()
    assert sorted(tuple(r)[:3] for r in found) == [(1, 20_000, 1), (4, 6, 1)]
    assert next(r["rendered"] for r in found if r["conv_id"] == 4) == "".join(f"<|{'user' if k % 2 == 0 else 'assistant'}|>\nt{k}<|end|>\n" for k in (5, 4, 3, 2, 1, 0))


def test_conversations_with_nulls_and_none_at_all(spark):
    schema = "conv_id long, turn long, role string, text string, prefix string"
    rows = [(None, None, None, None, "x"), (1, None, None, None, "x"), (2, 0, None, "", "x")]
    found = {r["conv_id"]: r["n_copies"] for r in maximal_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: 2, 2: 1}
    assert maximal_conversations(spark.createDataFrame([], schema)).count() == 0


def checked_packing(rows, texts, capacity=2048):
    """The pieces against the library's ids; the number of sequences."""
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        at = 0
        for n, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (n, at)
            assert n == 0 or p["length"] == capacity
            part = np.array(ids[at : at + p["length"]], dtype="<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_documents(spark, tables, documents):
    rows = queries.op6_bestfit_packing(spark, tables).collect()
    used = checked_packing(rows, {r["doc_id"]: r["text"] for r in documents.collect()})
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_of_odd_texts(odd):
    texts = dict(enumerate(ODD)) | {None: "no id"}
    path = queries.vocabulary("byte_bpe_50k.json")
    checked_packing(packing.pack(odd, path).collect(), texts)
    pieces = packing.pack(odd, path, with_ids=True)
    assert packing.sequences(pieces).count() == pieces.select("sequence_id").distinct().count()
    assert packing.pack(odd.limit(0), path).count() == 0


def test_the_fullest_bin_is_found():
    counts = {5: 1, 4: 2, 3: 1}
    assert sum(n * k for n, k in packing.fullest(counts, 11).items()) == 11
    assert sum(n * k for n, k in packing.fullest({6: 2, 7: 1}, 11).items()) == 7
    bins = packing.plan({6: 2, 5: 2, 4: 3, 3: 2}, 10)
    used = defaultdict(int)
    for times, chosen in bins:
        assert sum(n * k for n, k in chosen.items()) <= 10
        for n, k in chosen.items():
            used[n] += times * k
    assert dict(used) == {6: 2, 5: 2, 4: 3, 3: 2} and sum(t for t, _ in bins) == 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PRIVATE = [
    "write to a.b+c@mail.example.org, or x@y.z.", "a@b.c@d.e.f", "@x.y a@.b a@b a..b@c-d.e--f.g", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1111 5500000000000004 4111 1111 1111 1112", "4111  1111 1111 1111", "call +1 (555) 010-2030 now", "+49.30.1234567 +12 +1 2", "+1--23456789- +1234567890123456",
    "👍 a@b.co 日本 10.1.1.1 é +33 1 23 45 67 89", "1" * 400, "1.1." * 200, "a@" * 300, "+1 " * 300, "name at example dot com, phone: (555) 010-2030", "", None, "same", "same",
]


def test_personal_data_keeps_all_base_spans(spark, tables):
    texts = dict(enumerate(PRIVATE)) | {1000 + r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    table = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, kind string").repartition(4)
    rows = pii.find_personal_data(table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(text), text[:80]
        assert all(0 <= s["start"] < s["end"] <= len(text) for s in r["spans"])
    assert pii.find_personal_data(table.limit(0)).count() == 0


def test_personal_data_query(spark, tables):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    for r in queries.op8_pii_weak(spark, tables).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_packing_of_very_long_white_space(spark):
    texts = {1: " " * 1_200_000 + "x", 2: "a" + "\n" * 1_200_000 + "x", 3: (" " * 99_999 + "x") * 3, 4: "short text"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    checked_packing(packing.pack(rows, queries.vocabulary("byte_bpe_50k.json")).collect(), texts)


def test_pieces_one_by_one_and_together():
    """The recurrence over all words at once gives the ids of the one for each word."""
    model = Pieces(queries.vocabulary("piece_bpe_32k.model"))
    texts = [*ODD, "x" * 70, "a\nb\tc", "▁▁a▁b", "日本\n語 👍🏽\n", *["word %d naïve\n%d" % (k, k * k) for k in range(500)]]
    words = [model.words.findall(model.normalised(t or "")) for t in texts]
    assert model.encode_all(texts).to_pylist() == [[n for w in ws for n in model.best(w)] for ws in words]


def test_pieces_query(spark, tables, documents):
    model = Pieces(queries.vocabulary("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op1_sentencepiece(spark, tables).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = [n for w in model.words.findall(model.normalised(texts[r["doc_id"]])) for n in model.best(w)]
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_equal"] == (model.decode(ids) == texts[r["doc_id"]])


def test_pieces_of_nothing_and_clashing_columns(spark, odd):
    path = queries.vocabulary("piece_bpe_32k.model")
    clash = odd.withColumnsRenamed({"lang": "ids", "n_tokens": "decoded"})
    assert decode(encode(clash, path), path).count() == len(ODD) + 1
    rows = round_trip(clash, path).collect()
    assert len(rows) == len(ODD) + 1 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert round_trip(odd.limit(0), path).count() == decode(encode(odd.limit(0), path), path).count() == 0


def added(spark, texts):
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]] for r in rows}


def test_personal_data_adds_spans_that_its_labelers_vouch_for(spark):
    """Spelled-out addresses and local numbers with the right words before them come beside the base spans; order numbers don't."""
    base = [f"mail me at user{k}@example{k % 7}.org or call +1 555 010 {k:04d} now" for k in range(60)]
    spelled = [f"write to person{k} at example dot com about it" for k in range(40)]
    local = [f"phone (555) 010-{k:04d} in the evening" for k in range(1000, 1040)]
    orders = [f"order no 4111 1111 1111 {k:04d} was sent" for k in range(2000, 2040) if not luhn(f"411111111111{k:04d}")]
    found = added(spark, [*base, *spelled, *local, *orders])
    at = len(base)
    assert all(not found[k] for k in range(at))
    assert all(found[at + k] == [("email", f"person{k} at example dot com")] for k in range(40))
    assert all(found[at + 40 + k] == [("phone", f"(555) 010-{1000 + k:04d}")] for k in range(40))
    assert all(not found[at + 80 + k] for k in range(len(orders)))


def test_reliabilities_against_the_plain_formulas():
    """Expectation-maximisation written out span by span gives the same probabilities."""
    counts = {("ip", (1, 1, 0, 0)): 6, ("ip", (1, 0, 0, -1)): 3, ("ip", (1, -1, -1, 0)): 4, ("ip", (1, 1, 1, 0)): 2}
    spans = [v for (_, v), n in counts.items() for _ in range(n)]
    p = [1 / (1 + np.exp(-1.5 * (sum(v) - v.count(-1)))) for v in spans]
    for _ in range(30):
        share = (1 + sum(p)) / (2 + len(spans))

        def said(labeler, vote, weights):
            return (1 + sum(w for w, v in zip(weights, spans, strict=True) if v[labeler] == vote)) / (3 + sum(weights))

        no = [1 - x for x in p]
        table = {(j, vote): (said(j, vote, p), said(j, vote, no)) for j in range(4) for vote in (-1, 0, 1)}
        new = []
        for v in spans:
            yes, not_ = share, 1 - share
            for j, vote in enumerate(v):
                yes, not_ = yes * table[j, vote][0], not_ * table[j, vote][1]
            new.append(yes / (yes + not_))
        p = new
    found = pii.reliabilities(counts)
    assert all(found["ip", v] == pytest.approx(q, rel=1e-6) for v, q in zip(spans, p, strict=True))


def test_span_classifier_against_counts(spark):
    """The log odds are those of the features' counts, each weighed by what the votes make likely."""
    texts = [f"ip 10.0.{k}.1 and card 4111 1111 1111 1111, order 1234567890123{k % 10}" for k in range(30)]
    judged = pii.judged_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = [s for r in judged.select("found").collect() for s in r["found"]]
    odds = pii.span_classifier(judged)
    counts = defaultdict(float)
    for s in spans:
        counts[s["kind"], tuple(map(int, s["votes"].split(",")))] += 1
    likely = pii.reliabilities(counts)
    for kind in {s["kind"] for s in spans}:
        mine = [(s, likely[kind, tuple(map(int, s["votes"].split(",")))]) for s in spans if s["kind"] == kind]
        yes, no = sum(p for _, p in mine), sum(1 - p for _, p in mine)
        assert odds[kind] == pytest.approx(np.log((yes + 0.5) / (no + 0.5)))
        for feature in {f for s, _ in mine for f in s["features"]}:
            a, b = sum(p for s, p in mine if feature in s["features"]), sum(1 - p for s, p in mine if feature in s["features"])
            often = (a + b) / len(mine)
            assert odds[f"{kind}|{feature}"] == pytest.approx(np.log((a + often) / (yes + 1)) - np.log((b + often) / (no + 1)))


def test_personal_data_in_a_long_text_and_beside_clashing_columns(spark):
    text = "".join(f"w a.b{k}@mail.example.org, 10.0.0.1 +1 555 010 {k:04d} x " for k in range(700))
    table = spark.createDataFrame([(1, text, 2, "b", "r"), (2, None, 3, "c", "s")], "doc_id long, text string, email int, base string, row string")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(table).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[1]["spans"] if s["base"]] == base_spans(text)
    assert (rows[1]["email"], rows[1]["base"], rows[1]["row"], rows[2]["spans"], rows[2]["text"]) == (2, "b", "r", [], None)


def test_language_against_plain_kernels_and_ridge():
    """n-gram sets, kernel, landmarks and ridge regression written out on a few texts."""
    texts = ["the cat sat", "the dog ran to the house", "a house and a dog", "el gato y el perro", "la casa del perro", "un gato en la casa", "der hund und", "das haus und der hund"]
    langs = ["en", "en", "en", "es", "es", "es", "de", "de"]

    def plain(text):
        folded = "".join(chr(97 + int(c)) for c in (language._classes()[[ord(x) for x in text]]).tolist())
        padded = "a" + re.sub("a+", "a", folded.strip("a")) + "a"
        return {padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)}

    sets, own = [plain(t) for t in texts], [language.ngrams(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in own]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(sets[a] & sets[b]) == len(np.intersect1d(own[a], own[b]))
    model = language.fit(own, langs, landmarks=6, ridge=1e-3)
    chosen = [langs.index(x) + k for x in dict.fromkeys(langs) for k in range(2)]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in (sets[k] for k in sorted(chosen))] for a in sets])
    among, names = kernel[sorted(chosen)], sorted(set(langs))
    targets = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    weights = np.linalg.solve(kernel.T @ kernel + 1e-3 * len(texts) * among + 1e-8 * len(texts) * np.eye(6), kernel.T @ targets)
    np.testing.assert_allclose(model.kernel(own), kernel, rtol=1e-6)
    np.testing.assert_allclose(model.weights, weights, rtol=1e-4, atol=1e-6)
    scores = np.clip((kernel @ weights + 1) / 2, 1e-9, 1)
    said, share = model.predict(own)
    assert said == [names[k] for k in scores.argmax(axis=1)] == langs
    np.testing.assert_allclose(share, (scores / scores.sum(axis=1, keepdims=True)).max(axis=1), rtol=1e-4)


def test_many_languages_are_all_learned(spark):
    """300 languages of ten rows each: none is beyond a cap."""
    letters = [chr(0x4E00 + k) for k in range(900)]
    rows = [(k * 10 + n, " ".join([letters[3 * k], letters[3 * k + 1] + letters[3 * k + 2]] * (n + 2)), f"l{k}") for k in range(300) for n in range(10)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=1000)
    assert len(model.languages) == 300 and len(model.sizes) == 300
