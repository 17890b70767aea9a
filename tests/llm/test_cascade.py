"""What a page shows: the cascade against a plain one on random trees, details, lists and spans."""

import random
import re

import pytest

from attesta.llm.op05_html import parse, render

PAGES = {
    "<style>.x{display:none}</style><p class=x style='display:block'>own<p class=x>gone": "own",
    "<style>.x{display:none}.x{display:block}</style><p class=x>later": "later",
    "<style>#i{display:block}div{display:none}</style><div id=i>id</div><div>gone</div>": "id",
    "<style>.a .b{display:none}.c>.b{display:none}</style><div class=a><i><b class=b>gone</b></i></div><div class=c><b class=b>gone</b><i><b class=b>kept</b></i></div><b class=b>kept too</b>": "kept\nkept too",
    "<style>p.x.y{display:none}*{visibility:visible}</style><p class='y z x'>gone<p class=x>kept": "kept",
    "<style>p{display:none !important}</style><p style='display:block'>gone</p>kept": "kept",
    "<style>.k{display:block}</style><p hidden class=k>shown<p hidden>gone": "shown",
    "<style>a:hover{display:none}@media print{p{display:none}}</style><p><a>kept</a>": "kept",
    "<details><summary>head</summary>body</details><details open><summary>two</summary>open body</details><details>all hidden</details>": "head\ntwo\nopen body",
    "<ol reversed><li>a<li>b<li value=9>c<li>d</ol>": "4. a\n3. b\n9. c\n8. d",
    "<ol start=-1><li>a<li value=x>b</ol><ul><li value=7>c</ul>": "-1. a\n0. b\n\n- c",
    "<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</tbody><tbody><tr><td>e<td>f</tbody></table>": "A | b\n  | c\n  | d\ne | f",
    "<input value=typed> <input type=hidden value=no><input type=password value=no><input type=submit value=Go>": "typed Go",
    "<style>.v{visibility:hidden}</style><div class=v>gone<b style='visibility:visible'>seen</b></div>": "seen",
    "<div style='background:url(display:none)'>kept</div><div style='DISPLAY : NONE;'>gone</div>": "kept",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert render(parse(page)) == PAGES[page]


def _plain(node, rules, chain, shown):
    """Text by trying every rule on every element, with the browser's order spelled out."""
    if isinstance(node, str):
        return [node] if shown else []
    tag, classes, ident, own, kids = node
    chain = [*chain, (tag, classes, ident)]
    wins = []
    for order, (parts, display) in enumerate(rules):
        pattern = "".join(("" if not i else ">" if how == ">" else " ") + f"{t}{c}{d}" for i, (how, t, c, d) in enumerate(parts))
        if _match(parts, chain):
            wins.append(((sum(bool(d) for _, _, _, d in parts), sum(bool(c) for _, _, c, _ in parts), sum(bool(t) for _, t, _, _ in parts)), order, display, pattern))
    display = own or (max(wins)[2] if wins else "inline")
    return [x for k in kids for x in _plain(k, rules, chain, shown and display != "none")]


def _match(parts, chain):
    fits = lambda p, e: (not p[1] or p[1] == e[0]) and (not p[2] or p[2][1:] in e[1]) and (not p[3] or p[3][1:] == e[2])
    if not fits(parts[-1], chain[-1]):
        return False
    if len(parts) == 1:
        return True
    ends = [len(chain) - 1] if parts[-1][0] == ">" else range(1, len(chain))
    return any(e > 0 and _match(parts[:-1], chain[:e]) for e in ends)


def test_random_trees():
    rng = random.Random(8)
    tags, names = ["b", "i", "em"], ["x", "y", "z"]
    for _ in range(300):
        n = iter(range(10**6))

        def tree(depth):
            kids = [tree(depth - 1) if depth and rng.random() < 0.6 else f"w{next(n)} " for _ in range(rng.randrange(1, 4))]
            return (rng.choice(tags), set(rng.sample(names, rng.randrange(3))), rng.choice(["", "", "p", "q"]), rng.choice(["", "", "", "", "none", "block"]), kids)

        def markup(t):
            if isinstance(t, str):
                return t
            tag, classes, ident, own, kids = t
            return f"<{tag} class='{' '.join(classes)}'" + (f" id={ident}" if ident else "") + (f" style='display:{own}'" if own else "") + ">" + "".join(map(markup, kids)) + f"</{tag}>"

        def part(how):
            t, c, d = rng.choice(["", *tags]), rng.choice(["", ".x", ".y", ".z"]), rng.choice(["", "", "#p"])
            return (how, t or ("b" if not c and not d else ""), c, d)

        rules = [([part("") if not i else part(rng.choice([" ", ">"])) for i in range(rng.randrange(1, 4))], rng.choice(["none", "block"])) for _ in range(rng.randrange(5))]
        css = "".join("".join((f" {how} " if how.strip() else " " if i else "") + t + c + d for i, (how, t, c, d) in enumerate(parts)) + "{display:" + display + "}" for parts, display in rules)
        root = tree(4)
        page = f"<style>{css}</style>{markup(root)}"
        assert re.findall(r"w\d+", render(parse(page))) == [x.strip() for x in _plain(root, rules, [], True)], page
