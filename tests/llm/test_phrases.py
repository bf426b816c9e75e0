import hashlib

from frames import SF, no_docs, odd_docs, texts

from tabulens.llm.phrases import Parse, edited_likeness, fingerprint, likeness, phrase_fingerprints
from tabulens.llm.queries import op9_phrase_fingerprints


def lz_phrases(data: bytes) -> set[bytes]:
    out, begin = set(), 0
    for end in range(1, len(data) + 1):
        if data[begin:end] not in out:
            out.add(data[begin:end])
            begin = end
    return out


def test_query_against_brute_force(spark):
    found = {r.doc_id: r for r in op9_phrase_fingerprints(spark, SF).collect()}
    docs = texts()[::-1]
    for k, (key, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) - len(text) // 3
        edited = text[:cut] + after[: len(text) // 3]
        r = found.pop(key)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(text), fingerprint(edited))
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, fingerprint(after))
    assert not found


def test_phrases_are_lempel_ziv_s():
    for text in ("abababababa", "", "a", "to be or not to be " * 40):
        parse = Parse()
        parse.read(text.encode())
        assert len(parse.known) == len(lz_phrases(text.encode()))


def test_likeness_estimates_the_jaccard_likeness_of_phrases():
    docs = [t for _, t in texts()][:40]
    for one, two in zip(docs, docs[1:], strict=False):
        a, b = lz_phrases(one.encode()), lz_phrases((one[: len(one) // 2] + two).encode())
        true = len(a & b) / len(a | b)
        if len(a) > 200:
            assert abs(likeness(fingerprint(one), fingerprint(one[: len(one) // 2] + two)) - true) < 0.2


def test_reading_in_parts_changes_nothing():
    text = "some words and some more words " * 50
    whole, parts = Parse(), Parse()
    whole.read(text.encode())
    for k in range(0, len(text), 17):
        parts.read(text[k : k + 17].encode())
    assert whole.fingerprint() == parts.fingerprint()


def test_a_full_dictionary_is_begun_anew(monkeypatch):
    import tabulens.llm.phrases as module

    monkeypatch.setattr(module, "MOST_PHRASES", 64)
    parse = Parse()
    parse.read(("some words and other words " * 200).encode())
    assert len(parse.known) <= 64 and parse.lanes is not None and parse.fingerprint() != module.EMPTY


def test_odd_rows(spark):
    rows = edited_likeness(odd_docs(spark)).collect()
    assert len(rows) == 9
    told = {r.doc_id: r for r in rows}
    assert told[2].fingerprint == told[3].fingerprint and told[2].near_edited == 1.0
    # Falling ids: 7, 6, 5, 4, 3, 2, 1, 1, null; the first follows the last.
    text = "a row without an id"
    edited = text[: len(text) - len(text) // 3] + "x" * (len(text) // 3)
    assert told[None].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert edited_likeness(no_docs(spark)).count() == 0
    assert phrase_fingerprints(odd_docs(spark)).count() == 9
    one = edited_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
