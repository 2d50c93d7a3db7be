"""Templates as columns."""

import pytest

from scriptorium.operators import templates

ROWS = [
    (1, "A & <b>", True, ["x", None, "y'"], ("in", [1, 2]), None, 0),
    (2, "", False, [], ("", []), "there", 7),
    (3, None, None, None, None, "", None),
]
SCHEMA = "id int, name string, ok boolean, parts array<string>, more struct<word:string,numbers:array<int>>, note string, n long"

CASES = [
    ("plain {{ id }}!", ["plain 1!", "plain 2!", "plain 3!"]),
    ("{{name}}|{{ ok }}|{{ n }}", ["A & <b>|True|0", "|False|7", "||"]),
    ("{% if ok %}good{% elif n > 3 %}many{% else %}bad{% endif %}", ["good", "many", "bad"]),
    ("{% if not name or parts|length == 3 and n == 0 %}1{% endif %}", ["1", "1", "1"]),
    ("{% if name and (ok or n) %}1{% else %}0{% endif %}", ["1", "0", "0"]),
    ("{% for p in parts %}{{ loop.index }}={{ p }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", ["1=x, 2=, 3=y'", "none", "none"]),
    ("{% for k in more.numbers %}{% for p in parts %}{{ k }}{{ p|upper }}{{ name }} {% endfor %}{% endfor %}", ["1XA & <b> 1A & <b> 1Y'A & <b> 2XA & <b> 2A & <b> 2Y'A & <b> ", "", ""]),
    ("{{ parts|join(', ') }};{{ parts|first }};{{ more.numbers|last }};{{ note|default('-') }}", ["x, y';x;2;-", ";;;there", ";;;-"]),
    ("{{ '/a/b/c.pdf'|basename }} {# a remark #}{{ ' x '|trim|length }}", ["c.pdf 1"] * 3),
    ("a\n  {% if ok %}\nyes {{ id }}\n  {% endif %}\nz", ["a\nyes 1\nz", "a\nz", "a\nz"]),
    ("{{ n == none }}{{ name != '' }}", ["FalseTrue", "FalseFalse", "TrueTrue"]),
]


@pytest.mark.parametrize(("template", "want"), CASES)
def test_text(spark, template, want):
    rows = templates.rendered(spark.createDataFrame(ROWS, SCHEMA), template)
    assert [r["entry"] for r in rows.orderBy("id").collect()] == want


def test_escapes(spark):
    rows = templates.rendered(spark.createDataFrame(ROWS[:1], SCHEMA), "<i>{{ name }}</i>{{ name|safe }}{{ name|escape }}{% for p in parts %}{{ p }}{% endfor %}", escape=True)
    assert rows.first()["entry"] == "<i>A &amp; &lt;b&gt;</i>A & <b>A &amp; &lt;b&gt;xy&#39;"


@pytest.mark.parametrize(("template", "said"), [("a\n{{ nobody }}", "line 2: the rows have no 'nobody'"), ("{% if ok %}", "endif is missing"), ("{% endif %}", "closes nothing"), ("{{ name|shout }}", "no filter"), ("{% while x %}", "no tag"), ("{% for x of y %}{% endfor %}", "for name in list"), ("{% for x in name %}{% endfor %}", "is no list"), ("{{ more.none }}", "no 'none'"), ("{{ a ? b }}", "not understood"), ("{{ }}", "missing"), ("{{ (id }}", "missing"), ("{{ id id }}", "not understood")])
def test_errors_tell_their_place(spark, template, said):
    with pytest.raises(ValueError, match=said):
        templates.rendered(spark.createDataFrame(ROWS, SCHEMA), template)


def test_nothing_leaves_the_jvm(spark):
    plan = templates.rendered(spark.createDataFrame(ROWS, SCHEMA), "{% for p in parts %}{{ p }}{% endfor %}")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
