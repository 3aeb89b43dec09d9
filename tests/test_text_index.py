"""The stored text index: postings come from each document's own row."""

from collections import defaultdict

from graphloom.operators import fulltext

WORDS = "the licensed benefits of licenses benefit licensing nature and the natural natures"


def test_a_token_is_not_written_by_itself_and_postings_are_whole(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "SPAN", 7)
    written = []
    keep = fulltext.materialise
    monkeypatch.setattr(fulltext, "materialise", lambda df, label: written.append(label) or keep(df, label))
    words = WORDS.split()
    docs = [(k, " ".join(words[(k + j * 5) % len(words)] for j in range(k % 23))) for k in range(60)] + [(60, None), (61, "")]
    for language in (None, "english"):
        index = fulltext.build_index(spark.createDataFrame(docs, "id bigint, text string"), language)
        stop = set(fulltext.stop_words(language)) if language else set()
        wanted, raw = defaultdict(list), set()
        for k, text in docs:
            kept = [w for w in (text or "").split() if w not in stop]
            raw |= set(kept)
            for at, w in enumerate(kept):
                wanted[(fulltext._analysed([w], language)[0], k)].append(at)
        rows = index.postings.collect()
        assert len(rows) == len(wanted)
        assert {(r.term, r.id): r.positions for r in rows} == wanted
        assert {(r.raw, r.term) for r in index.vocabulary.collect()} == {(w, fulltext._analysed([w], language)[0]) for w in raw}
    assert set(written) == {"text-documents", "vocabulary"}
