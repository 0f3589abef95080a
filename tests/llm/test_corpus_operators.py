import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tallyloom.llm import ann, chat, graph, line_dedup, matroska, mixing, packing, pii, simhash, substring_dedup, toxicity
from tallyloom.llm.registry import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lines_gone string"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n\n", "word", "same line that is long enough\nother", "same line that is long enough\nother", "x" * 30_000, "w " * 5_000]


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


# --- personal data: account numbers


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["pay BE68 5390 0754 7034 BANK now", "be68539007547034", "GB29 NWBK 6016 1331 9268 19 REF 12", "gb29nwbk60161331926819", "NO93 8601 1117 947, MT84MALT011000012345MTLCAST001S", "xBE68539007547034", "BE68 5390 0754 7034A", "BE68 5390 0754 7035", "ZZ68 5390 0754 7034"]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.pii if s.kind == "iban"] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    assert got == {0: ["BE68 5390 0754 7034"], 1: [texts[1]], 2: ["GB29 NWBK 6016 1331 9268 19"], 3: [texts[3]], 4: ["NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"], 5: [], 6: [], 7: [], 8: []}


# --- mixing: many sources


def test_targets_of_a_hundred_thousand_sources(spark):
    import time

    sizes = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 97 + 1).alias("source_size"))
    start = time.time()
    total, given = mixing.source_targets(sizes).agg(F.sum("target"), F.sum("source_size")).first()
    assert time.time() - start < 20 and abs(total - 1.5 * given) < 1e-6 * given


# --- components


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 2)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- line dedup


def brute_lines(texts):
    edit = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and any(a[:i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    seen, gone = [], set()
    for d, t in enumerate(texts):
        for n, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" ")
            if line:
                if line in (x for x, _ in seen) or any(len(line) >= 20 and len(x) >= 20 and edit(line, x) for x, _ in seen):
                    gone.add((d, n))
                seen.append((line, (d, n)))
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(25)]

    def edited(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])

    texts = ["\n".join(rng.choice([str, edited, lambda s: edited(edited(s))])(rng.choice(base)) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [t for t in ODD if t is None or len(t) < 1000]
    got = {(r.doc_id, r.line_no) for r in line_dedup.near_lines(docs_of(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_of_ids_that_repeat_with_other_texts(spark):
    """Whatever the order of the rows, each document's lines meet and go on their own."""
    a, b = "the first line of one document", "another line that is long enough"
    rows = [(1, a), (1, b), (2, a.replace("first", "fir5t")), (3, b.replace("long", "lung")), (1, "own line one\n" + a), (1, b)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {r.doc_id for r in line_dedup.near_lines(docs).filter("distance = 1").collect()} == {2, 3}
        texts = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).filter("not all_gone").collect())
        assert len(texts) in (3, 4) and [t for t in texts if t[1].startswith("own")] == [(1, "own line one" if len(texts) == 4 else "own line one\n" + a)] and texts.count((1, b)) == 2


def test_line_dedup_of_twenty_thousand_repeated_lines(spark):
    lines = [f"line {i // 2}" for i in range(40_000)]
    (row,) = line_dedup.dedup_lines(docs_of(spark, ["\n".join([*lines, "", "last"])])).collect()
    assert row.text == "\n".join([*lines[::2], "", "last"]) and row.lines_gone == 20_000


def test_line_dedup_odd_rows(spark):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, ODD)).collect()}
    assert out[0].text is None and out[4].text == ODD[4] and out[5].text == "" and out[5].all_gone and out[5].lines_gone == 2
    assert out[2].text == ODD[2] and not out[2].all_gone and out[6].text == ODD[6]
    assert line_dedup.dedup_lines(docs_of(spark, ["a"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a line of more than twenty characters"), (None, "a line of more than twenty characters"), (1, "a line of more than twenty characterz")], "doc_id long, text string")
    assert [(r.doc_id, r.distance) for r in line_dedup.near_lines(nulls).collect()] == [(1, 1)]


# --- Matroska


@pytest.mark.parametrize("n", [64, 128, 512 * 8, 512 * 8 * 8 + 64, 512 * 64 * 5 + 192])
def test_matroska_round_trip(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(n))
    data = matroska.write(payload)
    media = matroska.read(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in media.packets) == payload
    assert media.doctype == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and len(media.cues) == media.packets[-1][6] + 1
    at = 0
    for _, ns, _, size, *_ in media.packets:
        assert ns <= at * media.scale
        at += size
    assert {p[5] for p in media.packets} <= set(matroska.LACINGS)


def test_matroska_ebml_lacing_and_unknown_sizes():
    sizes = [300, 20, 900, 5]
    block = matroska._vint(1) + (7).to_bytes(2, "big") + bytes([0x80 | 3 << 1]) + matroska._laced(sizes, 3) + bytes(sum(sizes))
    cluster = b"\x1f\x43\xb6\x75" + b"\xff" + matroska._number(matroska.TIMECODE, 100) + matroska._element(matroska.SIMPLE_BLOCK, block)
    data = matroska._element(matroska.EBML, matroska._element(matroska.DOCTYPE, b"webm")) + b"\x18\x53\x80\x67" + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    media = matroska.read(data)
    assert [p[3] for p in media.packets] == sizes * 2 and {p[1] for p in media.packets} == {107 * 1_000_000} and media.packets[-1][6] == 1


def test_matroska_cues_name_the_bytes_of_their_cluster(spark):
    data = matroska.write(bytes(range(256)) * 300)
    media = matroska.read(data)
    assert media.duration == 76_800 and media.tracks[1]["rate"] == 8000 and media.tracks[1]["frame_ns"] == 512 * 125_000
    assert [p[1] // 125_000 for p in media.packets] == list(np.cumsum([0] + [p[3] for p in media.packets])[:-1])
    files = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "y"), (3, bytearray(b"\x1a"), "z")], "doc_id long, media binary, packet string")
    got = matroska.cues(files).orderBy("cue").collect()
    assert len(got) == len(media.cues) == 3
    packets = {r.packet: r for r in matroska.packets(files).filter("doc_id = 1").collect()}
    for r in got:
        assert data[r.first_byte : r.first_byte + 4] == b"\x1f\x43\xb6\x75" and packets[r.packet].timestamp_ns == r.timestamp_ns
        inside = [p for p in packets.values() if p.cluster == r.cluster]
        assert all(r.first_byte < p.first_byte and p.first_byte + p.n_bytes <= r.first_byte + r.n_bytes for p in inside)
    assert {p.packet for p in packets.values() if p.cued} == {r.packet for r in got}
    # A cue beside its cluster names none, and its packet is not cued.
    wrong = data[: len(data) - 1] + bytes([data[-1] ^ 1])
    file = spark.createDataFrame([(1, bytearray(wrong))], "doc_id long, media binary")
    assert [r.cluster for r in matroska.cues(file).orderBy("cue").collect()] == [0, 1, None]
    assert matroska.packets(file).filter("cued").count() == 2


def test_matroska_elements_stay_within_their_parent():
    inner = matroska._number(matroska.TIMECODE, 5)
    cluster = matroska.CLUSTER.to_bytes(4, "big") + matroska._vint(len(inner) - 1) + inner
    with pytest.raises(matroska.Malformed, match="longer"):
        matroska.read(matroska._element(matroska.SEGMENT, cluster + bytes([0xEC, 0x81, 0])))
    with pytest.raises(matroska.Malformed, match="outside"):
        matroska.read(matroska._element(matroska.SEGMENT, matroska._element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x80abc")))


def test_scores_of_empty_tables_repeated_rows_and_a_clashing_column(spark):
    docs = docs_of(spark, ["you stupid idiot", "a kind word", None, "", "you stupid idiot"])
    labels = spark.createDataFrame([(i, i in (0, 4)) for i in range(5)], "doc_id long, toxic boolean")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels.limit(0)).lexicon is None
    by_id = {r.doc_id: r.toxicity for r in toxicity.score(docs.withColumn("toxicity", F.lit("old")), model).collect()}
    assert len(by_id) == 5 and by_id[0] == by_id[4] and by_id[2] == by_id[3] and all(0 <= v <= 1 for v in by_id.values())
    kept = toxicity.score(docs.withColumn("toxicity", F.lit("old")), model, name="fresh")
    assert {r.toxicity for r in kept.collect()} == {"old"} and "fresh" in kept.columns


def test_empty_tables_and_clashing_columns(spark):
    """op2, op4 and op5 on no rows, and beside columns named like their own."""
    docs = docs_of(spark, ["mail a@b.org", None, ""])
    for made in (lambda d: matroska.features(matroska.to_media(d)), pii.find_pii):
        assert made(docs.limit(0)).count() == 0 and made(docs).count() == 3
    odd = docs.withColumn("media", F.lit("m")).withColumn("n_bytes", F.lit("n"))
    assert matroska.features(matroska.to_media(odd)).exceptAll(matroska.features(matroska.to_media(docs))).count() == 0
    assert matroska.to_media(docs.union(docs)).count() == 6


def test_matroska_query_and_broken_bytes(spark):
    out = {r.doc_id: r for r in matroska.features(matroska.to_media(docs_of(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert out[0].media_sha256 == out[1].media_sha256
    files = spark.createDataFrame([(1, bytearray(b"\x1a\x45")), (2, None), (3, bytearray(matroska.write(b"a" * 64)))], "doc_id long, media binary")
    got = matroska.packets(files).collect()
    assert [(r.doc_id, r.error is None, r.cued) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, False, None), (3, True, True)]


# --- packing


def test_encoder_equals_the_tokenizer(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = documents.text.dropna().tolist()[:60] + ["", "It's<|endoftext|>fine", "İstanbul ΟΔΟΣ x\u0085y z", "á ́b", "tab\tand\r\nline", "don't 123 !!"]
    want = [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing._encoder(path)(texts) == want


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 500, 20_000):
        h = {int(k): int(n) for k, n in zip(*np.unique(np.minimum(64, 1 + rng.geometric(0.08, size)), return_counts=True), strict=True)}
        used = {}
        for parts, n in packing.plan(h, 64):
            assert 0 < sum(x * m for x, m in parts) <= 64 and n > 0
            for x, m in parts:
                used[x] = used.get(x, 0) + m * n
        assert used == h


def test_packing_is_gapless_and_whole(spark, data):
    rows = QUERIES["op3_packing"](spark, data).toPandas()
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all() and g.length.sum() <= 4096 for _, g in by)
    assert (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()
    assert rows.length.sum() / (by.ngroups * 4096) > 0.97
    odd = packing.pack(packing.pieces(docs_of(spark, ODD), __import__("public_tokenizers").path("word_bpe_49k.json"))).toPandas()
    assert set(odd.doc_id) == set(range(len(ODD))) and odd[odd.doc_id == 0].length.tolist() == [1]
    assert packing.pack(packing.pieces(docs_of(spark, ["a"]).limit(0), __import__("public_tokenizers").path("word_bpe_49k.json"))).count() == 0


# --- personal data

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, found):
        digits = re.sub("[^0-9]", "", found)
        luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": all(len(p.lstrip("0")) <= 3 and int("0" + p.lstrip("0")) <= 255 for p in found.split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in CONTRACT.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def test_pii_matches_the_plain_patterns(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "_d@e.f", "..", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+12", " ", "é😀", "0001.02.3.4", "x@y", "@", "+", "5500000000000004", "1.2.3.4.5.6.7.8", "-", "a.b@c-d.e-f.g", "+49 (0) 30 1234-56)", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ODD + ["1" * 20_000, "a" * 50_000, "x@" + "a." * 20_000 + "b", "1 " * 20_000]
    for r in pii.find_pii(docs_of(spark, texts)).select("doc_id", "pii").collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] == brute_spans(texts[r.doc_id]), texts[r.doc_id][:80]


def test_pii_of_twenty_thousand_spans_in_one_text(spark):
    text = "mail a@bc.de now, " * 20_000
    (row,) = pii.find_pii(docs_of(spark, [text])).select("pii").collect()
    assert [(s.start, s.end, s.score) for s in row.pii] == [(18 * i + 5, 18 * i + 12, 1.0) for i in range(20_000)]


def test_pii_reads_context_from_forty_characters_on_either_side(spark):
    far, near = "call " + "x " * 18, "call " + "x " * 17
    texts = [far + "+12345678901", near + "+12345678901", "+12345678901" + " y" * 18 + " call", "+12345678901" + " y" * 17 + " call", "1@b.c " * 9 + "mail", "9@b.c"]
    found = {r.doc_id: [s.score for s in r.pii] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    reach = lambda text, a, b: (text[max(a - pii.REACH, 0) : a] + " " + text[b : b + pii.REACH]).lower()
    for i, text in enumerate(texts):
        kind = "phone" if "+" in text else "email"
        spans = [(a, b) for k, a, b in brute_spans(text) if k == kind]
        words = [set(re.split(r"[^a-z0-9-]+", reach(text, a, b))) for a, b in spans]
        assert found[i] == [round(pii.PRIOR[kind] + pii.BONUS * bool(w & set(pii.CONTEXT[kind])), 3) for w in words], text


def test_pii_checksums_context_and_masks(spark):
    texts = ["Transfer to IBAN GB82 WEST 1234 5698 7654 32 today", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "mail a@b.c!"]
    found = pii.find_pii(docs_of(spark, texts))
    got = {r.doc_id: [(s.kind, s.score) for s in r.pii] for r in found.collect()}
    assert got == {0: [("iban", 1.0)], 1: [], 2: [("ssn", 0.7)], 3: [("email", 1.0)]}
    assert [r.text for r in pii.masked(found).orderBy("doc_id").collect()] == ["Transfer to IBAN [iban] today", texts[1], "my ssn is [ssn]", "mail [email]!"]


# --- toxicity


def test_automaton_accepts_exactly_the_edit_balls():
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    entries = {w: 3.0 for w in ("idiot", "scum", "disgusting", "moron", "pathetic")}
    lexicon = toxicity.FuzzyLexicon(entries, {"lowei": 3.0})
    tokens = ["".join(rng.choice("idotmrnscu") for _ in range(rng.randrange(3, 7))) for _ in range(3000)]
    for w in entries:
        for _ in range(200):
            t = list(w)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randrange(2)] = rng.choice([[], ["x"], ["i"]])
            tokens.append("".join(t))
    for t in tokens:
        want = min(((edit(t, w), w) for w in entries if edit(t, w) <= lexicon.allowed(w)), default=None)
        assert lexicon.match(t) == want, t
    assert lexicon.look_up('"Idiot!'.lower()) == ("word", "idiot", 0) and lexicon.look_up("loweixyz")[0] == "stem"


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["op5_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() > 0.93 and got[got.toxic == 0].predicted.mean() < 0.03


def test_toxicity_context_and_odd_rows(spark):
    lexicon = toxicity.FuzzyLexicon({"idiot": 4.0}, {})
    assert toxicity.features(lexicon, 'he said "you idiot" once')[6:8] == [pytest.approx(0.693147, 1e-5), 0.0]
    assert toxicity.features(lexicon, "you are an idiott")[7] > 0 and toxicity.features(lexicon, "a good day") == [0.0] * toxicity.FEATURES
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs_of(spark, ODD), toxicity.train(docs_of(spark, ODD), labels)).collect()
    assert len(out) == len(ODD) and {r.toxicity for r in out} == {0.0}


# --- chats


def test_chat_query_matches_plain_python(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = {r.conv_id: r for r in QUERIES["op6_chat"](spark, data).collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(r"\### Assistant: </turn> ok")
    for conv_id, g in turns.groupby("conv_id"):
        said = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text, strict=True))
        loss = "".join(t or "" for r, t in zip(g.role, g.text, strict=True) if r == "assistant")
        assert (got[conv_id].turns_sha256, got[conv_id].loss_sha256, got[conv_id].loss_chars) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))


def test_chat_escapes_and_odd_rows(spark):
    nasty = ["<|done|>", "\\<|turn|>", "<\\|", "\\", "", None, "a<", "\n\n x", "é😀" * 50, "x" * 20_000, "<|endoftext|>"]
    rows = [(1, i, "assistant" if i % 2 else "us<|body|>er", t) for i, t in enumerate(nasty)] + [(2, 0, None, "hi"), (2, 0, None, "hi"), (None, None, "assistant", "z")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), __import__("public_tokenizers").path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chats.collect()}
    assert chat.parse(got[1].formatted) == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256("".join(t or "" for i, t in enumerate(nasty) if i % 2).encode()).hexdigest()
    assert digest[2].n_turns == 2 and digest[2].loss_tokens == 0 and digest[None].loss_chars == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), __import__("public_tokenizers").path("byte_bpe_50k.json")).count() == 0


# --- mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sources", [["a", "b", "c", None, "d"], ["a"], ["z", "y"]])
def test_mixing_hits_its_targets(spark, sources):
    rng = random.Random(len(sources))
    texts = ["w " * int(rng.paretovariate(1)) for _ in range(300)] + [None, "", " \t "]
    named = [rng.choice(sources[:1] * 6 + sources) for _ in texts]
    sizes = {}
    for t, s in zip(texts, named, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    rows = mixing.mix(docs_of(spark, texts, named), cell_rows=20).collect()
    want, taken = plain_targets(sizes), {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(rows) == len(texts) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs_of(spark, texts, named), cell_rows=7).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_odd_rows_and_copies(spark):
    assert mixing.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    out = mixing.repeated(mixing.mix(docs_of(spark, ["one two three", None, "four"], ["a", "a", "b"]), keep=("text", "lang")))
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == 5 + 2  # targets 4.5 and 1.5, each rounded up
    spaced = ["  one\n\ttwo  three\n", "\nfour\nfive"]
    kept = [r.text for r in mixing.repeated(mixing.mix(docs_of(spark, spaced, ["a", "a"]), share=0.7, keep=("text",))).collect()]
    assert sum(len(t.split()) for t in kept) == 4 and all(any(s.startswith(t) for s in spaced) for t in kept)
    nulls = spark.createDataFrame([(None, f"a b c {i}", "s") for i in range(5)] + [(1, "d e", "s")] * 2, "doc_id long, text string, source string")
    assert abs(mixing.mix(nulls, share=0.5).agg(F.sum("taken")).first()[0] - 12) <= 1
    assert mixing.mix(docs_of(spark, ["a b", "c d e"], ["s", "s"]), importance=F.col("doc_id") + 1).agg(F.sum("taken")).first()[0] == 8


def test_pareto_inclusion_follows_importance(spark):
    rows = mixing.mix(docs_of(spark, ["w"] * 4000), share=0.3, importance=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).toPandas()
    even, odd = rows[rows.doc_id % 2 == 0].taken.mean(), rows[rows.doc_id % 2 == 1].taken.mean()
    assert abs(even - 0.45) < 0.04 and abs(odd - 0.15) < 0.04


# --- neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    v = (centers[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[100:400] = v[0]  # one very common vector
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, v[3].tolist()), (5, v[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, table.filter("vec_id % 100 = 0 or vec_id > 9000"), shard_rows=700).toPandas()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = sorted(range(3000), key=lambda i: (d[i], i))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and np.allclose(mine.score, d[mine.vec_id], rtol=1e-12, atol=1e-12)
        hit += len(set(want) & set(mine.vec_id))
        total += 10
        if q in (0, 100, 200, 300):
            assert mine.vec_id.tolist() == want
    assert hit / total >= 0.95 and set(got.query_id) == set(range(0, 3000, 100))
    few = table.filter("vec_id < 4 or vec_id = 100")
    assert ann.search(few, few.filter("vec_id = 100")).count() == 4
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 100])
def test_neighbours_in_tight_clusters_far_away(spark, scale):
    rng = np.random.default_rng(5)
    v = (scale * rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + 0.01 * rng.normal(size=(2000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], "vec_id long, embedding array<float>, rank string")
    got = ann.search(table, table.filter("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q in range(0, 2000, 100):
        d = ((v.astype(float) - v[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hit / 200 >= 0.95


def test_small_graphs_lose_no_point_and_odd_lengths_take_no_part(spark):
    rng = np.random.default_rng(6)
    for _ in range(40):
        graph = ann.Graph(rng.normal(size=(60, 3)) ** 3, degree=6)
        assert graph._reached().all() and sorted(graph.search(graph.points[:1], 96)[0][0][:60]) == list(range(60))
    table = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)] + [(7, [1.0]), (8, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert ann.search(table, table).select("query_id").distinct().count() == 5


@pytest.mark.parametrize("factor", [1.0, 1e-25, 1e20, 1 / 3])
def test_neighbours_walk_in_the_precision_that_holds_the_vectors(spark, factor):
    v = np.random.default_rng(8).normal(size=(400, 8)).astype(np.float32).astype(float) * factor
    assert ann.walkable(v).dtype == (np.float32 if factor == 1.0 else np.float64)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for sizes in ({"shard_rows": 90}, {"shard_bytes": 8 * 8 * 150}):
        got = ann.search(table, table.filter("vec_id % 100 = 0"), **sizes).toPandas()
        for q in range(0, 400, 100):
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            d[q] = np.inf
            mine = got[got.query_id == q].sort_values("rank")
            assert mine.vec_id.tolist() == np.argsort(d)[:10].tolist() and np.allclose(mine.score, d[mine.vec_id], rtol=1e-12, atol=0)


def test_a_far_query_does_not_leave_the_range_of_single_precision(spark):
    v = np.random.default_rng(9).normal(size=(50, 4)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    far = spark.createDataFrame([(1000, [1e30, 1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert ann.search(table, far).count() == 10


@pytest.mark.parametrize("shard_rows", [32_768, 200])
def test_neighbours_of_the_whole_table_by_brute_force(spark, shard_rows):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(rows, rows.filter("vec_id % 100 = 0"), shard_rows=shard_rows).toPandas()
    held = rows.filter(ann.usable(rows.embedding)).toPandas()
    v, ids = np.stack(held.embedding.to_list()).astype(float), held.vec_id.to_numpy()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((v - v[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got.query_id == q].vec_id))
        total += 10
    assert total and hit / total >= 0.95


# --- SimHash


def plain_fingerprint(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_matches_brute_force(spark, documents, data):
    rows = QUERIES["op9_simhash"](spark, data).collect()
    fp = {i: plain_fingerprint(t) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fp.items()}
    ids, root = sorted(fp), {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in ids}


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_hamming_links_are_exact_in_every_layout(spark, monkeypatch, layout):
    monkeypatch.setattr(simhash, "LAYOUTS", (layout,))
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)})
    want = {(max(i, j), min(i, j)) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    assert {tuple(r) for r in simhash.hamming_links(table).collect()} == want and want


def test_simhash_odd_rows(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, ODD)).collect()}
    assert {got[i].fp for i in (0, 1, 2)} == {0} and {got[i].component_id for i in (0, 1, 2)} == {0} and got[5].component_id == 4
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- passages


def test_fenwick_chains_match_the_plain_recurrence():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 25)
        p, q = rng.sample(range(60), n), [rng.randrange(60) for _ in range(n)]
        best = {}
        for i in sorted(range(n), key=lambda i: p[i]):
            best[i] = substring_dedup.SEED + max([0.0, *(best[j] - substring_dedup.GAP_COST * (p[i] - p[j] + q[i] - q[j]) for j in best if p[j] < p[i] and q[j] < q[i])])
        got = substring_dedup.chains(p, q)
        assert sorted(i for c in got for i in c) == list(range(n))
        c = got[0]
        score = len(c) * substring_dedup.SEED - substring_dedup.GAP_COST * sum(p[b] - p[a] + q[b] - q[a] for a, b in zip(c, c[1:], strict=False))
        assert score == pytest.approx(max(best.values()))


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(21)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    exact, fuzzy = fresh(60), fresh(120)
    texts = []
    for i in range(40):
        words = fresh(rng.randrange(80, 300))
        at = rng.randrange(len(words))
        if i < 12:
            words[at:at] = exact
        elif i < 24:
            copy = [w if rng.random() > 0.04 else "changed" + str(i) for w in fuzzy]
            del copy[50 + i]
            words[at:at] = copy
        texts.append(" ".join(words))
    texts += [texts[39], texts[39].upper(), None, "", "short text", "again " * 3000]
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    found = {i for r in rows for i in (r.doc_id, r.of_doc)}
    assert found == {*range(24), 39, 40, 41}
    for r in rows:
        assert (r.copy or (r.of_doc, r.doc_id) in {(x.doc_id, x.of_doc) for x in rows}) and r.matched >= 50 and r.identity >= 0.8
        if r.doc_id < 12:
            a, b = texts[r.doc_id].split()[r.start : r.end], texts[r.of_doc].split()[r.of_start : r.of_end]
            assert a[: len(exact)] == exact or a == b
    assert {r.doc_id for r in rows} == found and {(r.doc_id, r.of_doc) for r in rows if r.copy} == {(39, 41), (40, 39), (41, 39)}
    assert substring_dedup.repeated_passages(docs_of(spark, ["a"]).limit(0)).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def spans_of(rows):
    """doc -> the words that some row covers."""
    out = {}
    for r in rows:
        for d, s, e in ((r.doc_id, r.start, r.end), (r.of_doc, r.of_start, r.of_end)):
            out.setdefault(d, set()).update(range(s, e))
    return out


def uncovered(texts, rows, n=50):
    """(doc, start) of the runs of n words that stand in another text too and of which a row misses a word."""
    where, found = {}, spans_of(rows)
    for d, t in enumerate(texts):
        for i in range(len(t.split()) - n + 1):
            where.setdefault(tuple(t.split()[i : i + n]), set()).add((d, i))
    return {(d, i) for places in where.values() if len({d for d, _ in places}) > 1 for d, i in places if not found.get(d, set()) >= set(range(i, i + n))}


def test_passages_of_hot_lines_and_of_other_cuts_are_found(spark):
    rng = random.Random(5)
    one, two, long = words_of(rng, 30), words_of(rng, 30), words_of(rng, 400)
    texts = []
    for i in range(90):  # two hot lines, together in six texts only
        line = one + two if i % 15 == 0 else (one if i % 2 else two)
        texts.append(" ".join(words_of(rng, 40) + line + words_of(rng, 40)))
    for _ in range(60):  # windows of one passage, cut anywhere
        at = rng.randrange(340)
        texts.append(" ".join(words_of(rng, 30) + long[at : at + 60] + words_of(rng, 30)))
    assert uncovered(texts, substring_dedup.repeated_passages(docs_of(spark, texts)).collect()) == set()


def test_every_two_texts_with_a_passage_are_linked(spark):
    rng = random.Random(15)
    hot, texts, fuzzy = words_of(rng, 55), [], []
    for _ in range(12):  # one passage of many texts
        texts.append(" ".join(words_of(rng, 20) + hot + words_of(rng, 20)))
    for _ in range(60):  # every fifth word changed: runs of four words, few of which began a seed once
        passage = words_of(rng, 64)
        copy = [words_of(rng, 1)[0] if j % 5 == 4 else w for j, w in enumerate(passage)]
        fuzzy.append((len(texts), len(texts) + 1))
        texts += [" ".join(words_of(rng, 40) + x + words_of(rng, 40)) for x in (passage, copy)]
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.of_doc) for r in rows} == {(a, b) for a in range(12) for b in range(12) if a != b} | {x for a, b in fuzzy for x in ((a, b), (b, a))}


def test_seeds_of_one_text_are_not_joined(spark, monkeypatch):
    rng = random.Random(16)
    passage, seen = words_of(rng, 60), []
    texts = [" ".join(words_of(rng, 60) + (passage if i in (3, 30) else []) + words_of(rng, 60)) for i in range(40)]

    def stash(df, write=substring_dedup.stash):
        out = write(df)
        seen.extend([out.count()] if "key" in out.columns else [])
        return out

    monkeypatch.setattr(substring_dedup, "stash", stash)
    monkeypatch.setattr(substring_dedup, "SLICE", 500)
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.of_doc) for r in rows} == {(3, 30), (30, 3)}
    assert seen[0] == 2 * (60 - substring_dedup.SEED + 1)


def test_short_lines_of_many_texts_make_no_meetings_but_lose_no_pair(spark, monkeypatch):
    rng = random.Random(17)
    line, other, chained = words_of(rng, 13), words_of(rng, 20), []
    texts = [words_of(rng, 40) + (line if i % 2 else other[:13]) + words_of(rng, 40) for i in range(100)]
    # A fifth of what the last two share is changed: it is the line and 13 runs of three words around it.
    runs = [words_of(rng, 3) for _ in range(6)] + [line] + [words_of(rng, 3) for _ in range(7)]
    texts += [words_of(rng, 20) + [w for r in runs for w in r + words_of(rng, 1)] + words_of(rng, 20) for _ in range(2)]
    texts = [" ".join(t) for t in texts]

    def stash(df, write=substring_dedup.stash):
        out = write(df)
        chained.extend([out.count()] if "p" in out.columns else [])
        return out

    monkeypatch.setattr(substring_dedup, "stash", stash)
    rows = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r.doc_id, r.of_doc, r.matched) for r in rows} == {(100, 101, 52), (101, 100, 52)}
    assert sum(chained) < 20  # 2,500 and more where every common seed meets


def test_two_texts_with_a_passage_share_a_meeting_seed():
    rng = np.random.default_rng(18)
    for _ in range(150):
        m = int(rng.integers(50, 110))
        changes = np.sort(rng.choice(m - 1, int(rng.integers(0, m // 4 + 1)), replace=False)) + 1  # words before which one is changed, put in or left out
        words, sides = rng.integers(0, 1 << 16, m), [[], []]
        for i, w in enumerate(words.tolist()):
            if i in changes:
                for side in [(0, 1), (0,), (1,)][rng.integers(0, 3)]:
                    sides[side].append(int(rng.integers(0, 1 << 16)))
            for x in sides:
                x.append(w)
        hot = [words[k : k + 13].tolist() for k in rng.integers(0, m - 13, 3)]  # pieces that many other texts have
        noise = lambda n: rng.integers(0, 1 << 16, n).tolist()
        texts = [noise(70) + x + noise(70) for x in sides] + [noise(5) + hot[i % 3] + noise(5) for i in range(int(rng.integers(0, 120)))]
        texts = [np.array(t, np.uint16) for t in texts]
        owner, h, _ = substring_dedup.seeds_of(texts)
        key = h.view(np.uint64) >> np.uint64(64 - substring_dedup.BITS)
        key, n = np.unique(np.unique(np.stack([key, owner.astype(np.uint64)], 1), axis=0)[:, 0], return_counts=True)
        text, seed, *_, ends = substring_dedup.meeting_seeds(texts, key[n > 1], n[n > 1], substring_dedup.shares(50, 0.8))
        assert set(seed[text == 0]) & set(seed[text == 1])


def test_each_occurrence_of_a_passage_is_found(spark):
    rng = random.Random(6)
    passage, line, other = words_of(rng, 60), words_of(rng, 8), words_of(rng, 20)
    texts = [
        words_of(rng, 30) + passage + words_of(rng, 100) + passage + words_of(rng, 30),
        words_of(rng, 50) + passage + words_of(rng, 20),
        (line + words_of(rng, 5)) * 3 + other + line + other[::-1] + line + words_of(rng, 9),  # refrains used before
        words_of(rng, 30) + other + line + other[::-1] + line,
        words_of(rng, 30) + ["hey"] * 130 + words_of(rng, 30),
        words_of(rng, 10) + ["hey"] * 60 + words_of(rng, 30),
        words_of(rng, 10) + ["ho", "hum"] * 45 + words_of(rng, 30),
        words_of(rng, 25) + ["hum", "ho"] * 110,
    ]
    texts = [" ".join(t) for t in texts]
    assert uncovered(texts, substring_dedup.repeated_passages(docs_of(spark, texts)).collect()) == set()


def test_passage_query_names_every_document_with_a_repeated_run(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op10_substring_dedup"](spark, data).collect()
    where = {}
    for d, t in docs:
        words = (t or "").lower().split()
        for i in range(len(words) - 50):
            where.setdefault(hash(tuple(words[i : i + 51])), set()).add(d)
    want = {d for ds in where.values() if len(ds) > 1 for d in ds}
    assert want and want <= {r.doc_id for r in rows}


def test_passages_of_repeated_ids_and_odd_rows(spark):
    rng = random.Random(12)
    passage = words_of(rng, 70)
    rows = [(1, " ".join(words_of(rng, 20) + passage)), (1, " ".join(passage + words_of(rng, 20))), (None, " ".join(passage)), (2, None), (2, ""), (2, " ")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, content string")
    assert substring_dedup.repeated_passages(table).count() == 0
    more = table.union(spark.createDataFrame([(3, " ".join(words_of(rng, 2) + passage).upper(), "y")], table.schema))
    assert {(r.doc_id, r.of_doc) for r in substring_dedup.repeated_passages(more).collect()} == {(1, 3), (3, 1)}


def test_passages_with_many_changed_words_are_found(spark):
    rng = random.Random(7)
    texts, groups = [], [(6, 1 / 6, True), (0, 0.1, False), (0, 0.15, False)]
    for every, share, _ in groups:
        for i in range(60):
            passage = words_of(rng, 66)
            copy = [words_of(rng, 1)[0] if (j % every == i % every if every else rng.random() < share) else w for j, w in enumerate(passage)]
            texts += [" ".join(words_of(rng, 40) + x + words_of(rng, 40)) for x in (passage, copy)]
    found = {(r.of_doc, r.doc_id) for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect() if r.of_doc < r.doc_id}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)
    same = [sum(x == y for x, y in zip(texts[i].split(), texts[i + 1].split(), strict=True)) for i in range(0, len(texts), 2)]
    # A passage with fewer words alike than 50, or more changed than a fifth, is none.
    whole = [i for i, n in enumerate(same) if n >= 54]
    assert len(whole) > 120 and sum((2 * i, 2 * i + 1) in found for i in whole) >= 0.97 * len(whole)


# --- SQL twins


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, data, name):
    from tests.oracle import compare

    compare(spark, data, QUERIES[name], ORACLES[name])
