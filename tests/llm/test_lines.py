from patronage.llm.lines import line_dedup


def brute(rows):
    """doc_id -> (n_lines, n_removed, kept text) by a dictionary of first occurrences."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    numbered = {i: [k for k, x in enumerate(ls) if x.strip(" \t\n\x0b\x0c\r")] for i, ls in lines.items()}
    first = {}
    for i in sorted(lines):
        for p in range(len(numbered[i]) - 2):
            first.setdefault(tuple(lines[i][k] for k in numbered[i][p : p + 3]), (i, p))
    out = {}
    for i, ls in lines.items():
        gone = {k for p in range(len(numbered[i]) - 2) if first[tuple(ls[k] for k in numbered[i][p : p + 3])] != (i, p) for k in numbered[i][p : p + 3]}
        out[i] = (len(numbered[i]), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone))
    return out


def test_matches_brute_force(make_docs, odd_texts):
    rows = odd_texts + [(20, "a\nb\nc\nd"), (21, "x\n\nb\n \nc\nd\ny"), (22, "q\nq\nq\nq\nq"), (23, "a\nb"), (24, "a\r\nb\r\nc\r\n"), (25, "\n\n\n"), (26, "a\nb\nc\nd")]
    got = line_dedup(make_docs(rows), carry=("lang", "size")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got} == brute(rows)
    assert {(r.lang, r["size"]) for r in got} == {("en", "x")}


def test_null_ids_and_empty_table(make_docs):
    got = sorted(line_dedup(make_docs([(None, "a\nb\nc"), (1, "a\nb\nc")])).collect(), key=lambda r: r.doc_id or 99)
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (None, 3)]
    assert line_dedup(make_docs([])).collect() == []


def test_many_lines_in_one_text(make_docs):
    text = "\n".join(str(k % 700) for k in range(6000))
    assert [(r.n_lines, r.n_removed) for r in line_dedup(make_docs([(1, text)])).collect()] == [(6000, 6000 - 700)]


def test_texts_under_one_id_are_told_apart(make_docs):
    """Each text loses its own repeats alone, whatever its doc_id; of a window in two of them one place stays."""
    short, long = "p\nq\nr", "u\nv\nw\n" + "\n".join(f"line {k}" for k in range(40)) + "\na\nb\nc"
    for i in (None, 7):
        got = {r.kept_text: (r.n_lines, r.n_removed) for r in line_dedup(make_docs([(1, "a\nb\nc"), (i, short), (i, long)])).collect()}
        assert got == {"a\nb\nc": (3, 0), short: (3, 0), long.removesuffix("\na\nb\nc"): (46, 3)}
        twice = line_dedup(make_docs([(i, "a\nb\nc"), (i, "a\nb\nc\nd"), (i, "a\nb\nc\nd")])).collect()
        left = sorted(r.kept_text for r in twice)
        assert left in (["a\nb\nc", "d", "d"], ["", "a\nb\nc\nd", "a\nb\nc\nd"])
