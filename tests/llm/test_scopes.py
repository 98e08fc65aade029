"""Parts of a credential are linked wherever in a text they stand."""

from siltstone.llm import secrets

KEY, NAME, HOST = "aB3" + "xYz0" * 9 + "q", "ASIA1234ABCD5678", "https://db.example.com:5432/main"


def at(n: int, *parts: tuple[int, str]) -> str:
    """A text of n characters without blank lines that has the parts at their positions."""
    text = ("word " * (n // 5 + 1))[:n]
    for start, part in parts:
        text = text[: start - 1] + " " + part + " " + text[start + len(part) + 1 :]
    return text


def plain(text: str) -> list[str]:
    """Every pair of parts, with the blank-line gaps between them counted."""
    base = secrets.base_spans(text)
    weak = secrets.weak_spans(text, base)

    def near(a: int, b: int) -> bool:
        return abs(a - b) <= secrets.SCOPE_CHARS and sum(min(a, b) < m.end() <= max(a, b) for m in secrets.BLANK.finditer(text)) <= 1

    spans = list(base)
    for a, k, b in weak:
        roles = {secrets.ROLE[secrets.KINDS[o]] for x, o, _ in base + weak if near(a, x)}
        if {3: "material" in roles, 4: bool({"identifier", "endpoint"} & roles), 5: {"identifier", "material"} <= roles}[k]:
            spans.append((a, k, b))
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def test_parts_across_a_multiple_of_the_scope_length(spark):
    texts = [at(6000, (1970, NAME), (2010, KEY)), at(9000, (3990, HOST), (4030, KEY)), at(9000, (4080, NAME), (4110, KEY)), at(6000, (1000, NAME), (3000, KEY)), at(6000, (1000, NAME), (3001, KEY))]
    texts += [f"id {NAME}\n\n{KEY}", f"id {NAME}\n \n\n\n{KEY}", f"id {NAME}\n\nother\n\n{KEY}", at(9000, (1500, NAME), (3400, KEY), (5300, HOST)), at(9000, (1500, NAME), (2500, HOST), (3400, KEY))]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_linked"] for i in range(len(texts))] == [2, 1, 2, 2, 0, 2, 2, 0, 2, 3]
    assert [got[i]["spans"] for i in range(len(texts))] == [",".join(plain(t)) for t in texts]
