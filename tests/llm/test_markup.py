import pytest

from gristmill.llm import markup as M


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<p>One &amp; two</p>", ["html"]), ("a &nbsp; b", ["html"]), ("# Head\n\ntext", ["markdown"]), ("Head\n----\n\ntext", ["markdown"]), ("an **odd** word", ["markdown"]), ("an _odd_ word", ["markdown"]), ("~~gone~~", ["markdown"]), ("[a](b.md)", ["markdown"]), ("![a](b.png)", ["markdown"]),
        ("use `code` here", ["markdown"]), ("```\nx\n```", ["markdown"]), ("| a | b |\n|---|:--|\n| c | d |", ["markdown"]), ("- [ ] task", ["markdown"]), ("== Head ==", ["wiki"]), ("a [[link|word]] b", ["wiki"]), ("an ''odd'' word", ["wiki"]), ("a {{term|word}}", ["wiki"]), ("{| class=x\n|-\n| a || b\n|}", ["wiki"]),
        (r"\section{Head} text", ["latex"]), (r"\begin{itemize}" + "\n" + r"\item one" + "\n" + r"\end{itemize}", ["latex"]), (r"where $x \leq 3$ holds", ["latex"]), (r"an \textbf{odd} word", ["latex"]), ("# Head\n\nwhere $R = P$ holds", ["latex", "markdown"]),
        ("- item\n- item\n1. one\na) two", []), ("7.2 Tested plan at quillon\n\ntext", []), ("TESTED PLAN:\n\ntext", []), ("stay < 5 and > 2 & below 9", []), ("from $4,500 to $9,000 per case", []), ("Levels 2 * 3; see the note*.", []), (r"Paths such as C:\logs\audit", []), ("audit_log_export and role_map", []),
        ("Use [value set] and {role} or <name>", []), ("a == b", []), ("Ticket #31 is #1", []), ("section 4_2 and form AB_17", []), ("ends here (*)", []), ("key = 3\nother = 4", []), ("A | B | C\nd | e | f", []), ("", []),
    ],
)
def test_kinds(text, kinds):
    assert M.clean_markup(text)[0] == kinds


def test_structure_stays_and_nothing_is_marked_afterwards():
    text = "\n".join([
        "# Head one", "", "A *paragraph*, with [a link](x.md), long enough to be read as prose by the scoring of the tree.", "", "- item one", "- item two", "", "```ini", "key_one = 1", "```", "", r"where $\frac{a}{b} \leq 3$ applies", "", "| A | B |", "|---|---|", "| c | d |",
    ])
    kinds, clean, headed = M.clean_markup(text)
    assert kinds == ["latex", "markdown"] and headed
    assert "§ Head one" in clean and "- item one\n- item two" in clean and "    key_one = 1" in clean and "(a)/(b) ≤ 3" in clean and "A  B\nc  d" in clean
    assert M.clean_markup(clean)[0] == []


def test_link_lists_beside_the_content_go():
    text = "<div><p>" + "The content, of some length, with commas, and words. " * 5 + "</p></div><div>" + "".join(f'<a href="{i}">Menu entry {i}</a> ' for i in range(20)) + "</div>"
    clean = M.clean_markup(text)[1]
    assert "content, of some length" in clean and "Menu entry" not in clean


@pytest.mark.parametrize("tag", ['<iframe src="x"/>', '<svg width="3" />', "<script>", '<style type="a">', "<template>", "<object>", "<head>", "<select>", "<textarea>", "<button>", "<noscript>", "<svg>"])
def test_text_after_an_element_without_end_stays(tag):
    kinds, clean, _ = M.clean_markup(f"Before {tag} between.\n\n# Head\n\nAfter **odd** word, where $x \\leq 3$ holds.")
    assert kinds == ["html", "latex", "markdown"]
    assert clean == "Before  between.\n\n§ Head\n\nAfter odd word, where x ≤ 3 holds."


def test_only_elements_with_an_end_are_dropped():
    assert M.clean_markup("<svg> one <svg><g>x</g></svg> two <script>write('<script src=\"y\">'); a = 1</script> three")[1].split() == ["one", "two", "three"]
    assert M.clean_markup("Set <script> first.\n\n```\n<script>a</script>\n```\n\nLast.")[1] == "Set  first.\n\n    <script>a</script>\n\nLast."
    assert M.clean_markup("Press <button>Save</button>, pick <select><option>A</option><option>B</option></select> <textarea>Note</textarea> <object>Shown</object> <noscript>Plain</noscript>")[1].split() == ["Press", "Save,", "pick", "A", "B", "Note", "Shown", "Plain"]


def test_table(spark):
    rows = [("a", "<b>x</b>", 1), ("a", "<b>x</b>", 1), ("b", None, 2), ("c", "", 3), ("d", "plain", 4), ("e", "<p>" + "word, " * 50_000 + "</p>", 5), ("f", "<div>" * 3000 + "deep", 6)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, markup int")
    got = {r.chunk_id: r for r in M.clean_documents(df).collect()}
    assert set(got) == {"a", "e", "f"}
    assert got["a"].text == "x" and got["a"].markup == ["html"] and got["a"].has_headers is False
    assert len(got["e"].text) > 200_000
    assert M.clean_documents(df.limit(0)).collect() == []


def test_depth_and_length_have_no_limit():
    assert M.clean_markup("\\emph{" * 5000 + "x" + "}" * 5000)[:2] == (["latex"], "x")
    assert M.clean_markup("<div>" * 5000 + "Deep text, of some length." + "</div>" * 5000)[1] == "Deep text, of some length."
    long = "$" + "a_1 + " * 400 + "b$"
    assert M.clean_markup(f"where {long} holds")[0] == ["latex"] and "$" not in M.clean_markup(f"where {long} holds")[1]
    assert M.clean_markup("so *a _b *c _d *e* f_ g* h_ i* on")[1] == "so a b c d e f g h i on"


def test_letters_of_headings_stay_as_they_are():
    assert M.clean_markup("# Straße and pH\n\ntext *odd*")[1] == "§ Straße and pH\n\ntext odd"


def test_kinds_are_carried_by_the_tree():
    parser = M.Parser("<p>one *odd* word</p>\n\n== Head ==\n\nwhere $x_1 = 2$ holds")
    M.score_tree(parser.root)
    assert parser.root.kinds == {"html", "markdown", "wiki", "latex"}
    paragraph = next(c for c in parser.root.children if isinstance(c, M.Node))
    assert paragraph.kinds == {"html", "markdown"}
