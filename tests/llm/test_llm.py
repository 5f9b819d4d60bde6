import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from crossload.llm import decontaminate, html_text, media, ngram_join, packing, quality, suffix_dedup, tool_calls, toxicity, url_filter

DOC = "doc_id long, text string"
rng = random.Random(7)


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    base, passage = prose(120), prose(60)
    near = base.split()
    near[5] = "changed"
    texts = [None, "", "   ", "one two", "ONE two", base, base, " ".join(near), prose(50) + " " + passage + " " + prose(50), prose(90) + " " + passage, "é" * 500]
    texts += [" ".join(near[:40] + [f"v{k}"] + near[41:]) for k in range(30)]
    return list(enumerate(texts))


def test_url_filter(spark):
    urls = ["http://A.example.NET/en/1?x", "http://net", "http://b.net/", "http://x.example.com/de/", "http://x.org/fr/a", "nourl", None, "http://notnet/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("old"))
    got = [(r.rule, r.verdict) for r in url_filter.filter_urls(df).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"),
                   (None, "allow"), (None, "allow"), (None, "allow")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_packing(spark, docs):
    df = spark.createDataFrame(docs + [(99, prose(9000)), (99, prose(9000))], DOC)
    rows = packing.pack(packing.cut(df).cache()).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in docs} | {99}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack(packing.cut(df.limit(0)).cache()).count() == 0


def test_packed_sequences_hold_the_tokens(spark, docs):
    import zlib

    df = spark.createDataFrame(docs + [(99, prose(9000))], DOC)
    encode = packing.encoder()
    packed = packing.stage_packing(spark, df, "").cache()
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    texts = collections.defaultdict(dict)
    for r in packed.collect():
        ids = whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert ids == bytes(r.ids) and zlib.crc32(ids) == r.ids_crc32
        texts[r.doc_id][r.start] = ids
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in packed.collect())
    for i, t in df.collect():
        want = b"".join(k.to_bytes(4, "little") for k in [*encode(t or ""), packing.END_ID])
        assert b"".join(texts[i][s] for s in sorted(texts[i])) == want


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_join(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(docs, DOC)).collect()}
    assert got == brute_components(docs)
    assert ngram_join.link(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated, "__defaults__", (suffix_dedup.WINDOW, hot))
    seen = collections.Counter(b[k : k + 200] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - 199))
    got = {r.doc_id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.cut_repeats(spark.createDataFrame(docs, DOC)).collect()}
    for i, t in docs:
        b = (t or "").encode()
        gone = {p for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1 for p in range(k, k + 200)}
        assert got[i] == (len(gone), hashlib.sha256(bytes(x for p, x in enumerate(b) if p not in gone)).hexdigest())


def test_decontaminate(spark, docs):
    item = prose(40)
    edited = item.split()
    edited[10], edited[25] = "new", "other"
    more = docs + [(100, prose(80) + " " + item + " " + prose(20)), (101, " ".join(edited))]
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.matches(spark.createDataFrame(more, DOC), items).where("score >= 0.5").collect()}
    assert got == {100, 101}


def test_toxicity(spark):
    bad, rows = ["vilest", "gr0ss"], []
    for k in range(80):
        rows.append((prose(20) + (f" {bad[k % 2]}" if k % 4 < 2 else ""), int(k % 4 < 2)))
    train = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.fit(train)
    probe = spark.createDataFrame([(1, "abcd G R"), (2, "abcd VILE5T abcd"), (3, None), (4, "so gross")], DOC)
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[2] > 0.7 and got[4] > 0.7 and got[1] < 0.5 and got[3] == got[1]
    assert toxicity.fit(train.limit(0))["lexicon"] == {}


def test_quality(spark):
    rows = [(prose(60), 1) for _ in range(40)] + [(prose(60).upper().replace(" ", "!! "), 0) for _ in range(40)]
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    probe = spark.createDataFrame([(1, prose(60)), (2, prose(60).upper().replace(" ", "!! ")), (3, None), (4, "")], DOC)
    got = {r.doc_id: r.score for r in quality.score(probe, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]


def test_html(spark):
    page = ("<html><nav><a href=x>Menu</a></nav><article><h1>Big &amp; bold</h1><p>Some <b>te</b>xt\n here.<div class='ad'>Buy <p>now</p></div>"
            "<p>End of it all.</article><div class=comments>me too</div><footer>c</footer>")
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>only <script>x()")], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == {1: "Big & bold Some text here. End of it all.", 2: "", 3: "", 4: "only"}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("a", 1, 0, "answer", '{"turn": 1, "question": "q"}', None), ("a", 1, 9, "reply", "{}", None), ("b", 1, 1, "answer", '{"question": "q"}', "a"),
        ("c", 1, 2, "answer", '{"question": "q", "turn": 2}', "b"), ("x", 2, 0, "answer", '{"question": "q", "turn": 2}', "y"),
        ("y", 2, 1, "answer", '{"question": "q", "turn": 2}', "x"), (None, 3, 0, "answer", None, None), ("z", 3, 1, "who", None, "gone"),
    ], "call_id string, conv_id long, position long, tool string, arguments string, after string")
    results = spark.createDataFrame([("a", 1, "r")], "call_id string, position long, content string")
    got = {r.call_id: (r.depth, r.status) for r in tool_calls.link_calls(calls, results).collect()}
    assert got == {"a": (0, "ok"), "b": (1, "invalid"), "c": (2, "no_result"), "x": (None, "cycle"), "y": (None, "cycle"), "z": (0, "unknown_tool")}


def test_media(spark):
    import numpy as np

    gen = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in gen.normal(size=16)]) for k in range(60)] + [(60, None), (61, []), (62, [0.5]), (63, [0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r.media_id: r for r in media.find_copies(media.derived_media(df)).collect()}
    assert len(got) == 64 + 12
    assert got[126].class_id == 124 and got[120].component_id == 120
    copies = [k for k in got if k % 2]
    assert sum(got[k].component_id == k - 1 for k in copies) >= 0.9 * len(copies)
    assert all(got[k].component_id == got[k].class_id for k in got if k % 2 == 0)
    odd = spark.createDataFrame([(1, b""), (2, b""), (3, b"P5 2 2 255\nabcd"), (4, b"P5 x"), (5, None)], "media_id long, image binary")
    assert {r.media_id: r.component_id for r in media.find_copies(odd).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert media.find_copies(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 0])
def test_media_links_copies_behind_a_stranger(spark, crowd, monkeypatch):
    """A stranger with a smaller id that holds every key of two copies does not hide their link."""
    monkeypatch.setattr(media.matches, "__defaults__", (media.FAR_BITS, crowd))
    bits = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(6)]
    at = lambda ident, move: [(ident, n, *move(n), 1.0, 0.0, *b) for n, b in enumerate(bits)]
    rows = at(1, lambda n: (n * n * 97.0, n * 61.0)) + at(2, lambda n: (n * 20.0, n * 7.0)) + at(3, lambda n: (n * 20.0 + 3, n * 7.0 + 5))
    df = spark.createDataFrame(rows, "id long, corner int, x float, y float, scale float, angle float, d0 long, d1 long")
    assert [tuple(r) for r in media.consensus(df).collect()] == [(2, 3)]
    assert media.matches(df).count() == 3 * 6 * media.TABLES


@pytest.mark.parametrize("block", [10_000, 50])
def test_media_compares_all_holders_of_a_crowded_piece(spark, block):
    """Of 120 descriptors with one piece in common, every pair within the distance is found, not only those
    that differ in few bits."""
    gen = random.Random(4)
    rows = []
    for ident in range(120):
        flipped = sum(1 << k for k in gen.sample(range(32, 126), gen.randrange(30)))
        rows.append((ident, 0, 1.0, 1.0, 1.0, 0.0, (flipped ^ 77) & (2**63 - 1), flipped >> 64))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum((a[k] ^ b[k]).bit_count() for k in (6, 7)) <= media.FAR_BITS}
    assert len(want) > 1000
    df = spark.createDataFrame(rows, "id long, corner int, x float, y float, scale float, angle float, d0 long, d1 long")
    assert {(r.p.id, r.q.id) for r in media.matches(df, media.FAR_BITS, block).collect()} == want


def test_media_crops_and_resized(spark):
    """At least 0.9 of each kind: crops of half the area, crops of a quarter of large pictures, and resized copies."""
    import numpy as np

    gen, images, kind = np.random.default_rng(5), [], {}
    small, large = [media.draw(gen.normal(size=16)) for _ in range(30)], []
    for k in range(0, 24, 4):
        four = [media.draw(gen.normal(size=16)) for _ in range(4)]
        large.append(np.vstack([np.hstack(four[:2]), np.hstack(four[2:])]))
    edits = [("half", small, lambda i: i[14:82, 20:88]), ("smaller", small, lambda i: media.resize(i, 72, 72)), ("larger", small, lambda i: media.resize(i, 144, 144)),
             ("quarter", large, lambda i: i[50:146, 40:136])]
    for n, image in enumerate(small + large):
        images.append((10 * n, media.write_grey(image)))
    for e, (name, of, edit) in enumerate(edits):
        for n, image in enumerate(of):
            ident = 10 * (n + (len(small) if of is large else 0)) + e + 1
            images.append((ident, media.write_grey(edit(image))))
            kind[ident] = name
    got = {r.media_id: r.component_id for r in media.find_copies(spark.createDataFrame(images, "media_id long, image binary")).collect()}
    assert all(got[i] == i for i in got if i % 10 == 0)
    for name in ("half", "smaller", "larger", "quarter"):
        found = [got[i] == i // 10 * 10 for i in kind if kind[i] == name]
        assert sum(found) >= 0.9 * len(found), (name, sum(found), len(found))


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    made, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder()
    odd = ["", " ", "a\n\n b", "e \u0301x", "it's  <|endoftext|> we'll<|startoftext|>", "x\x1cy\tz\u00a0w", "\u03a3\u03a3 \u03a3", "!!! ??\n12 34", " lead", "trail \n"]
    odd += ["".join(rng.choice("aB1 '\n\t!\u00e9\u0301\u4e2d\u200b\u3000<|>s") for _ in range(60)) for _ in range(400)]
    for t in odd:
        assert encode(t) == made.encode(t, add_special_tokens=False).ids, repr(t)


def test_html_quotes_in_tags(spark):
    weights = {"a": -0.1, "p": -0.1}
    assert html_text.extract("<article><p>Alpha beta <a title=it's>gamma</a> delta</p></article>", weights) == "Alpha beta gamma delta"
    assert html_text.extract("<article><p>Alpha <a title=\"it's\" data-x=\"broken>gamma</a> delta</p></article>", weights) == "Alpha gamma delta"
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_tool_arguments_are_checked_strictly(spark):
    given = ['{"question": 5, "turn": 1}', '{"question": "q", "turn": "1"}', '{"turn": 2, "question": "q", "more": 1}', '{"turn": 2, "question": "q"}', '[1]', "no", None]
    calls = spark.createDataFrame([(str(k), 1, k, "answer", g, None) for k, g in enumerate(given)], "call_id string, conv_id long, position long, tool string, arguments string, after string")
    results = spark.createDataFrame([("3", 1, "r"), ("lost", 2, "r")], "call_id string, position long, content string")
    got = {r.call_id: (r.status, r.message) for r in tool_calls.link_calls(calls, results).collect()}
    assert got.pop("3") == ("ok", '{"arguments":"{\\"question\\":\\"q\\",\\"turn\\":2}","id":"3","result":"r","tool":"answer"}')
    assert got.pop("lost")[0] == "no_call" and {s for s, _ in got.values()} == {"invalid"}
    assert tool_calls.link_calls(calls.limit(0), results.limit(0)).count() == 0


STAGED = "doc_id long, text string, n_chars long, sig string, kept string, density string, score string, th string, difference string"


def staged(spark, docs):
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c}{i}" for c in "skdsth")) for i, t in docs], STAGED)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """labels and benchmark for the stages."""
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1, int(k >= 1000)) for k in range(1100)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


ITEM = prose(40)


def test_stages_keep_columns_nulls_and_clean_rows(spark, sf):
    """Each stage on odd rows: no id, big ids, repeated rows, no text, and columns with clashing names."""
    big, base = 2**53 + 1, prose(120)
    passage, long_text = prose(70), prose(3000)
    rows = [(None, prose(30)), (None, None), (big, prose(30)), (5, ""), (5, None), (6, base), (6, base), (7, base), (8, prose(40) + " " + passage), (9, prose(45) + " " + passage), (10, prose(9) + " " + ITEM), (11, long_text)]
    rows += [(1000 + k, prose(15) + " vilest") for k in range(8)] + [(200 + k, prose(15)) for k in range(8)]
    docs = staged(spark, rows)
    for stage in (toxicity.stage_toxicity, ngram_join.stage_near_copies, suffix_dedup.stage_repeats, decontaminate.stage_decontaminate):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = out.collect()
        ids = [r.doc_id for r in kept]
        assert big in ids and None in ids and all(r.sig == f"s{r.doc_id}" and r.score == f"s{r.doc_id}" for r in kept), stage
        if stage is toxicity.stage_toxicity:
            assert not any(i is not None and 1000 <= i < 1100 for i in ids) and len(ids) == len(rows) - 8
        if stage is ngram_join.stage_near_copies:
            assert ids.count(6) == 1 and 7 not in ids and ids.count(None) == 2 and len(ids) == len(rows) - 2
        if stage is suffix_dedup.stage_repeats:
            by = {r.doc_id: r for r in kept}
            assert 6 not in by and 7 not in by and passage not in by[8].text and by[8].n_chars == len(by[8].text) and by[11].text == long_text
        if stage is decontaminate.stage_decontaminate:
            assert 10 not in ids and len(ids) == len(rows) - 1
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    """The whole pipeline on a small table with one planted case for each stage."""
    import corpus_pipeline

    base, passage, hits = prose(120), prose(70), {}
    near = base.split()
    near[60] = "changed"
    texts = {1: base, 2: " ".join(near), 3: prose(50), 4: prose(40) + " " + passage, 5: prose(30) + " " + passage, 6: prose(9) + " " + ITEM, 7: None}
    texts |= {1000 + k: prose(15) + " vilest" for k in range(8)} | {200 + k: prose(15) for k in range(8)}
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    for r in corpus_pipeline.run(spark, sf).collect():
        hits.setdefault(r.doc_id, b"")
        hits[r.doc_id] += bytes(r.ids)
    assert set(hits) == {1, 3, 4, 5, 7, *range(200, 208)}
    encode = packing.encoder()
    for i in (1, 3, 7):
        assert hits[i] == b"".join(k.to_bytes(4, "little") for k in [*encode(texts[i] or ""), packing.END_ID])


def test_packing_is_best_fit_decreasing(spark):
    """As many sequences as a plain best fit of the same lengths."""
    lengths = [rng.randint(1, 4096) for _ in range(300)] + [1] * 50 + [4096] * 3
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long").cache()
    rows, gaps = packing.pack(df).collect(), []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        gaps.append((gaps.pop(gaps.index(min(fit))) if fit else packing.CAPACITY) - n)
    assert len({r.sequence_id for r in rows}) == len(gaps)


def test_large_ids_pass_beside_null_ones(spark):
    df = spark.createDataFrame([(9007199254740993, "a b c"), (None, "d e f")], DOC)
    assert {r.doc_id for r in packing.cut(df).collect()} == {9007199254740993, None}
    assert {r.doc_id for r in ngram_join.link(df).collect()} == {9007199254740993, None}


def test_suffix_array_and_common_prefixes():
    """Against sorted suffixes and prefixes counted byte by byte, with repeats, one letter only, and zeros at the end."""
    import numpy as np

    for t in range(80):
        n = rng.randint(0, 600)
        raw = bytes(rng.choice((b"ab\0", b"a", b"abcd", b"\0")[t % 4]) for _ in range(n)) * (1 + t % 3)
        got = np.frombuffer(raw, "uint8")
        order = suffix_dedup.suffix_array(got)
        assert list(order) == sorted(range(len(raw)), key=lambda i: raw[i:])
        if raw:
            most = rng.choice((8, 20, 200))
            shared = suffix_dedup.common_prefixes(got, order, most)
            for i, j in zip(order, order[1:]):
                x, y = raw[i : i + most].ljust(most, b"\0"), raw[j : j + most].ljust(most, b"\0")
                assert shared[j] == next((k for k in range(most) if x[k] != y[k]), most)


def test_suffix_dedup_merges_across_shards(spark, docs, monkeypatch):
    """Strings of a crowded anchor that lie in different shards are found by merging ranges."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "RANGE_STRINGS", 300)
    texts = docs + [(500, "a" * 60_000), (501, "b" * 199), (502, "xyz" * 100), (500, "a" * 60_000)]
    found = lambda hot: {
        (r.doc_id, r.sig): {k for p in spans for k in p}
        for r, spans in (
            (r, [range(a.lo, a.hi + 1) for a in r.all])
            for r in suffix_dedup.repeated(suffix_dedup.signed(spark.createDataFrame(texts, DOC)).select("doc_id", "sig", "text").dropDuplicates(["doc_id", "sig"]), 200, hot)
            .groupBy("doc_id", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("all")).collect()
        )
    }
    split, whole = found(1), found(10**9)
    assert split == whole
    by = {doc: places for (doc, _), places in split.items()}
    assert by[500] == set(range(60_000 - 199)) and 501 not in by and by[502] == set(range(101))
    assert by[5] == by[6] == set(range(len(texts[5][1]) - 199))
