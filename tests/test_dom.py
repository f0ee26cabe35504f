"""Pages as trees: a selector is sought once a page, only where it can match."""

from tidemark.operators import dom
from tidemark.operators import html as H


def test_selectors_look_only_where_they_can_match(monkeypatch):
    seen, matches = [], dom._matches
    monkeypatch.setattr(dom, "_matches", lambda node, *rest: seen.append(node) or matches(node, *rest))
    root = dom.parse("".join(f'<div class="card card"><h2><a class="t">{i}</a></h2><p>x</p></div>' for i in range(200)))
    cards = root.select(".card")
    assert len(cards) == 200
    seen.clear()
    assert [c.first("h2 .t").text() for c in cards] == [str(i) for i in range(200)]
    assert len(seen) <= 200 * 2  # each link and its heading
    seen.clear()
    assert not any(c.firsts(("h2 .absent", ".absent .t", "[data-none]", "#none")) for c in cards) and not seen


def test_matches_below_a_node():
    root = dom.parse('<div id="o" class="x"><p class="x">a<b class="x y">c</b></p>d</div><p class="x">e<script>f</script></p>')
    outer = root.first("#o")
    assert [n.text("|") for n in root.select(".x")] == ["a|c|d", "a|c", "c", "e"]
    assert [n.text("|") for n in outer.select(".x")] == ["a|c", "c"] and outer.first(".y, p").text() == "ac"
    assert outer.first("b").first("*") is None and root.first("script").text() == "f" and root.first(".x + p.x").text() == "e"


def test_tasks_grow_with_the_pages_not_faster():
    """Enough tasks for all cores, then 2048 pages a task: reading is worth far more than starting the task."""
    assert [H._tasks(n, 12) for n in (0, 1, 65, 3200, 20_000)] == [1, 1, 2, 48, 48]
    assert H._tasks(7_200_000, 12) == 3516 and H._tasks(10**9, 12) == H.TASKS
