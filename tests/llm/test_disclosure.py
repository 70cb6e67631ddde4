"""Terms that reveal personal data: entities of a single document, and terms away from the entity."""

import re

from lineforge.llm import privacy

FILLER = ["weather", "market", "garden", "music", "river", "window"]
OTHERS = [(10 + i, f"things about {FILLER[i % 6]} wrote on report {FILLER[(i + 2) % 6]}") for i in range(60)]


def test_entity_of_one_document_has_disclosing_terms(spark):
    rows = [(0, "report weather about Quillfeather wrote q@mail.example.com on market things"), *OTHERS]
    clean = {r.doc_id: r.text for r in privacy.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "report weather about [TERM] wrote [EMAIL] on market things"
    assert all(clean[i] == text for i, text in OTHERS)


def test_terms_far_from_the_entity_and_in_other_documents(spark):
    far = "things about market wrote on report " * 40
    rows = [(k, f"Quillfeather {far}q@mail.example.com {far}QUILLFEATHER end, Quillfeatherly") for k in range(3)]
    rows += [(5, f"about Quillfeather {far}"), (6, "unquillfeather about"), (None, "Quillfeather"), *OTHERS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in privacy.personal_data(docs).collect()}
    for k in range(3):
        text = rows[k][1]
        places = [text.index("Quillfeather"), text.index("QUILLFEATHER")]
        assert {f"generalised:{p}:{p + 12}" for p in places} <= set(got[k].split(","))
        assert f"removed:{text.rindex('Quill')}:{len(text)}" in got[k]
    assert got[5] == "generalised:6:18" and not got[6] and got[None] == "generalised:0:12"
    assert not any(got[i] for i, _ in OTHERS)


def test_words_are_moved_once_a_row(spark, monkeypatch):
    """The look-up of every document's words is the largest shuffle: a row there has its word, not its lower-case form beside it."""
    plans, written = {}, privacy.written

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(privacy, "written", seen)
    rows = [(0, "report weather about Quillfeather wrote q@mail.example.com on market things"), *OTHERS]
    assert privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert "lower(word" in plans["hits"] and not re.search(r"lower\(word#\d+\) AS ", plans["hits"])
