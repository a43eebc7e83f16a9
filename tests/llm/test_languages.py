"""Languages of documents."""

import pytest
from pyspark.sql import functions as F

from packlake.llm import languages, queries

SENTENCES = {
    "en": ["The scanner reads the whole tree before it counts the rows.", "Nobody knows why this still depends on the old order."],
    "de": ["Der Wert muss zu dem passen, was die Rangfolge erwartet.", "Niemand weiß, warum das noch von der alten Reihenfolge abhängt."],
    "fr": ["La valeur doit correspondre à ce que le classement attend.", "Personne ne sait pourquoi cela dépend encore de cet ordre."],
    "es": ["El valor debe coincidir con lo que el escáner espera ahora.", "Nadie sabe por qué todavía depende de la caché."],
    "it": ["Il valore deve coincidere con quello che il modulo si aspetta.", "Nessuno sa perché questo dipende ancora dalla cache."],
    "pt": ["O valor deve coincidir com o que o orçamento espera agora.", "Ninguém sabe por que isso ainda depende do arquivo."],
    "nl": ["De waarde moet overeenkomen met wat de scanner verwacht.", "Niemand weet waarom dit nog steeds van het bestand afhangt."],
    "sv": ["Värdet måste stämma med det som rangordningen väntar sig.", "Ingen vet varför det här fortfarande behöver filen."],
    "pl": ["Wartość musi się zgadzać z tym, czego oczekuje skaner.", "Nikt nie wie, dlaczego to nadal zależy od pliku."],
    "ru": ["Значение должно совпадать с тем, чего ждёт модуль оценки.", "Никто не знает, почему это всё ещё зависит от файла."],
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = []
    for n in range(12):
        for name, held in SENTENCES.items():
            rows.append((len(rows), " ".join(held), name, f"s{n % 2}", "readme", "docs/a.md", "z"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_kind string, rel_path string, label string")


@pytest.fixture(scope="module")
def model(documents):
    return languages.fit(documents)


@pytest.mark.parametrize(("label", "want"), [("EN", "en"), ("en_GB", "en"), ("es-419", "es"), ("Deutsch", "de"), ("français", "fr"), ("por", "pt"), (" svenska ", "sv"), ("und", None), ("n/a", None), ("", None), (None, None), ("ja", None)])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(languages.usable_label(F.col("l")).alias("x")).first()["x"] == want


def test_suffixes(spark):
    rows = [("docs/readme.de.md", "de"), ("docs/fr/a.md", "fr"), ("docs/a.md", None), ("it/x", "it"), (None, None)]
    assert [r["x"] for r in spark.createDataFrame(rows, "p string, w string").select(languages.suffix_language(F.col("p")).alias("x")).collect()] == [w for _, w in rows]


def test_sentences_of_prose():
    text = "# A heading without a stop\n\nThe scanner reads `a.b` twice. See src/a.py\n\n```python\nx = compute(a, b)\n# Der Wert muss hier noch passen.\n```\n1;2;3\n{\"a\": \"the value is not here\"}\n"
    found = [text[a:b].strip() for a, b, _ in languages.sentences(text)]
    assert found == ["The scanner reads `a.b` twice.", "Der Wert muss hier noch passen."]
    assert len(list(languages.sentences("x" * 300_000 + "\nThe scanner reads the tree. " + "a-b." * 50_000))) >= 1
    assert list(languages.sentences("")) == [] and list(languages.sentences("   \n")) == []


def test_documents(spark, documents, model):
    de, en, fr = SENTENCES["de"], SENTENCES["en"], SENTENCES["fr"]
    rows = [
        (1, " ".join(en), "en"), (2, " ".join(en), "de"), (3, en[0] + " " + de[0], "en"), (4, de[1], None), (5, None, "fr"), (6, "", None), (7, "  \n", "it"), (8, "src/a.py\nsrc/b.py\n", "nl"),
        (9, en[0].upper() + "\n\n" + fr[1].lower(), "unknown"), (10, "x = 1;\ny = 2;\n", "en"), (11, en[0] + ' ("ex ante")', "en"), (12, (en[1] + " ") * 4000, "ru"), (12, (en[1] + " ") * 4000, "ru"), (None, de[0], "en"),
    ]
    frame = spark.createDataFrame([(i, t, lang, None, None, None, "z") for i, t, lang in rows], documents.schema)
    labelled = languages.label_documents(frame, model)
    assert {(r["doc_id"], r["lang"]) for r in languages.unnamed_languages(labelled).collect()} == {(2, "en"), (3, "de"), (4, "de"), (9, "en"), (9, "fr"), (12, "en"), (None, "de")}
    best = {r["doc_id"]: (r["lang"], r["n_sentences"]) for r in languages.document_languages(labelled).collect()}
    assert best[2] == ("en", 2) and best[5] == ("fr", 0) and best[6] == (None, 0) and best[12] == ("en", 4000)
    pieces = sorted((r["start"], r["lang"], r["confidence"] > 0.95) for r in languages.segments_of(labelled).where("doc_id = 3").collect())
    assert pieces == [(0, "en", True), (len(en[0]) + 1, "de", True)]
    assert languages.unnamed_languages(languages.label_documents(frame.limit(0), model)).count() == 0


def test_held_out_sentences(model):
    """Sentences the model was not fitted on."""
    unseen = {"en": "I would rather keep it because the tests are slow.", "de": "Ich konnte das auf meinem Rechner nicht nachstellen.", "fr": "Je préfère garder cela parce que les tests sont lents.", "es": "Prefiero dejarlo porque las pruebas son muy lentas.", "it": "Preferisco tenerlo perché le prove sono molto lente.", "pt": "Eu prefiro deixar assim porque os testes são lentos.", "nl": "Ik laat het liever zo omdat de testen traag zijn.", "sv": "Jag vill hellre behålla det eftersom testerna är långsamma.", "pl": "Wolę to zostawić, ponieważ testy są bardzo powolne.", "ru": "Я бы оставил это, потому что тесты очень медленные."}
    right = 0
    for name, text in unseen.items():
        (_, _, words), = languages.sentences(text)
        right += languages.LANGUAGES[int(model.score(words).argmax())] == name
    assert right >= 9


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    rows = queries.QUERIES[name](spark, data)
    assert len(rows.columns) >= 1 and rows.count() >= 0
