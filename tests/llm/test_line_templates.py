from tesserae.llm import line_templates

from .helpers import awkward, documents

NOTE = "Copyright notice number {} applies to this whole page and to all of its parts today."
FIELD = "Posted on the board by {} in the main hall for all of the members to read."
NAMES = "anna bert carl dora emil fred gina hans ida jan kurt lena".split()


def corpus(spark):
    docs = []
    for i in range(12):
        own = [f"Own words {chr(97 + i) * 3} are kept here since no other page has {chr(98 + i) * 4} them, nor will one ever come to have them at all."]
        docs.append("\n".join([*own, NOTE.format(1000 + i), FIELD.format(NAMES[i]), "Yes."]))
    docs += ["A page that has many copies is left to a later stage.\nIt has two lines that only the copies share."] * 15
    return documents(spark, [*docs, None, ""])


def test_templates_with_variable_fields_go(spark):
    df = corpus(spark)
    got = {r.doc_id: r for r in line_templates.strip(df).collect()}
    assert len(got) == df.count()
    for i in range(12):
        assert got[i].text.split("\n")[1:] == ["Yes."] and got[i].text.startswith("Own words")
        assert got[i].n_chars == len(got[i].text)
    before = {r.doc_id: r.text for r in df.collect()}
    assert all(got[i].text == before[i] for i in range(12, 29))


def test_report_counts(spark):
    rows = {r.doc_id: r for r in line_templates.report(corpus(spark)).collect()}
    assert [(rows[i].n_lines, rows[i].n_dropped) for i in (0, 12, 27, 28)] == [(4, 2), (2, 0), (1, 0), (1, 0)]


def test_what_hides_and_what_does_not(spark):
    own = lambda k: "".join(chr(97 + int(d)) for d in str(k)).title() + " is a word that no other page has ever had on it."
    head = "This very long header stands above each of the pages of one great source, and is longer than all that they say."
    foot = "And this footer, which is long as well, closes every page of the same great source without any change at all."
    passage = "A passage that unrelated pages share."
    hot = [f"{head}\n{own(k)}\n{own(k + 30)}\n{own(k + 60)}\n{foot}" for k in range(12)]
    some = [f"{own(100 + k)}\n{passage}" for k in range(3)]
    copies = [f"The original has this line.\nThe original has that line too.\nAnd a third one follows here.\n{passage}\nThen copy {w} ends the page here." for w in "abcdefghijklmnopqrst"]
    field = [f"{own(200 + k)}\nPosted on the board by {w}" for k, w in enumerate(("Anna", "Bert", "Carl"))]
    two = [f"{own(300 + k)}\nSent at noon by {a} of the old town hall to {b} in the valley below." for k, (a, b) in enumerate((("Anna", "Dora"), ("Bert", "Emil"), ("Carl", "Fred")))]
    texts = [*hot, *some, *copies, *field, *two, passage, passage]
    got = {r.doc_id: r.text.split("\n") for r in line_templates.strip(documents(spark, texts)).collect()}
    at = 0
    for k in range(12):
        assert got[k] == texts[k].split("\n")[1:-1]  # header and footer go, though each is longer than what is between
    at = 12
    assert all(got[at + k] == [own(100 + k)] for k in range(3))  # twenty copies do not outvote three pages
    assert all(got[15 + k] == [x for x in texts[15 + k].split("\n") if x != passage] for k in range(20))  # and keep their own lines
    assert all(got[35 + k] == [own(200 + k)] for k in range(3)) and all(got[38 + k] == [own(300 + k)] for k in range(3))
    assert got[41] == got[42] == [""]


def test_awkward_rows_stay(spark):
    df = awkward(spark)
    after = line_templates.strip(df)
    assert after.columns == df.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(after.collect()) == key(df.collect())
    assert line_templates.report(documents(spark, [])).count() == 0


def test_masking_reads_whole_tokens(spark):
    df = spark.createDataFrame([("a1b cc 22, -3 x",), ("none here",), ("",)], "s string")
    assert [r[0] for r in df.select(line_templates.masked(df.s)).collect()] == ["<*> cc <*> <*> x", "none here", ""]


def test_no_python_in_the_plan(spark):
    plan = line_templates.report(documents(spark, ["a"]).select("doc_id", "text").where("doc_id >= 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
