from tarnlake.operators import extract as X


def test_markdown_table():
    got = X.tables_of("text\n  | a | b | c |\n  |---|---|---|\n  | 1 | 2 | 3 |\n  | 4 | 5 | 6 |\n\nmore")
    assert got == [[["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"]]]


def test_borderless_table():
    assert X.markdown_blocks("Run | Steps | Loss\n--- | ----- | ----\nfirst | 900 | 1.7\n")[0][0] == "| Run | Steps | Loss |"


def test_one_column_without_a_separator_is_a_table():
    assert X.tables_of("| name |\n| first |\n| second |") == [[["name"], ["first"], ["second"]]]


def test_github_tables(spark):
    """Numbered from 0; alike tables are each kept; a large file is null, one without tables empty."""
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    files = spark.createDataFrame([("x", f"{table}\nand\n\n{table}"), ("large", table + "w" * 200), ("none", "prose"), ("null", None)], "name string, text string")
    got = {r.name: r.tables for r in X.github_tables(files, most_bytes=150).collect()}
    assert [t.name for t in got["x"]] == ["x_table_0.csv", "x_table_1.csv"] and got["x"][1].rows == [["1", "2"]]
    assert got["large"] is None and got["none"] == [] and got["null"] == []


def test_one_bar_is_no_table():
    assert X.tables_of("this | that is prose") == []


def test_empty_cells_stay():
    assert X.tables_of("|||Recall|Speed|\n|---|---|---|---|\n|Heron|2B|0.61|140|") == [[["", "", "Recall", "Speed"], ["Heron", "2B", "0.61", "140"]]]
    assert X.tables_of("|a|b|c|d|\n|-|-|-|-|\n|1|2||4|\n|5||7|8|")[0][1:] == [["1", "2", "", "4"], ["5", "", "7", "8"]]
    assert X.tables_of("|Tree|Height|Leaf||\n|-|-|-|-|\n|Oak|22|lobed||")[0] == [["Tree", "Height", "Leaf", ""], ["Oak", "22", "lobed", ""]]


def test_same_table_in_html_and_markdown_is_one():
    md = "| a | b |\n|---|---|\n| 1 | 2 |"
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert len(X.tables_of(f"{html}\n\n{md}\n\n| x | y |\n|---|---|\n| 3 | 4 |\n\n| only | header |\n|---|---|\n")) == 2


def test_spans_repeat_text():
    html = "<table><tr><td rowspan='2'>m</td><td colspan='2'>x</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert X.tables_of(html) == [[["m", "x", "x"], ["m", "1", "2"]]]


def test_one_row_html_and_badges_go():
    assert X.tables_of("<table><tr><td>x</td></tr></table>") == []
    badges = "| | | |\n|---|---|---|\n| ![a](img.shields.io/1) | ![b](badge) | ![c](badge) |"
    assert X.tables_of(badges) == []


def test_null_empty_and_long():
    assert X.tables_of(None) == [] and X.tables_of("") == []
    assert X.tables_of("word " * 10_000) == []


def test_split_row_escapes():
    assert X.split_row(r"| a \| b | `x | y` |") == ["a | b", "`x | y`"]


def test_bibtex():
    text = 'see\n@article{k,\n title={A {Deep} Net},\n author = "B, C",\n year=2020\n}\n@bad\n'
    blocks = X.bibtex_blocks(text)
    assert len(blocks) == 1
    got = X.parse_bibtex(blocks[0])
    assert (got["entry_type"], got["title"], got["author"], got["year"], got["doi"]) == ("article", "A {Deep} Net", "B, C", "2020", None)
    assert X.parse_bibtex("no entry") is None and X.bibtex_blocks(None) == []


def test_yaml_tags():
    assert X.yaml_tags("a: 1\nb: [x, y]") == ({"a": "1", "b": "x, y"}, None)
    assert X.yaml_tags("- x")[0] == {} and X.yaml_tags("a: [")[1] and X.yaml_tags(None) == ({}, None)


def test_titles_and_contexts():
    assert X.readme_title("x\nRepository files navigation\n\n[a]\n# One\n# Two\ntext") == "OneTwo"
    assert X.readme_title("a\n# Head\n") == "Head" and X.readme_title(None) is None
    assert X.table_context("Table 2: s\n\nthe table is here\n\nother") == {"captions": ["Table 2: s"], "mentions": ["the table is here"]}


def test_paper_and_answer_tables():
    html = '<figure class="ltx_table"><figcaption>c</figcaption><table><tr><td><math alttext="x^2">y</math></td></tr></table></figure><figure class="ltx_table"><table><tr><td>no caption</td></tr></table></figure>'
    assert len(X.paper_tables(html)) == 1
    assert X.answer_tables("```markdown\n| a | b |\n|---|---|\n| 1 | 2 |\n```") == [[["a", "b"], ["1", "2"]]]
