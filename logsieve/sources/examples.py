"""A text that a pattern matches, made from the pattern itself, so that fixtures reach every rule."""

from re import _parser as parser


def example(pattern: str) -> str:
    """The shortest match that takes the first alternative everywhere; look-behinds are written out."""
    return "".join(_text(op, value) for op, value in parser.parse(pattern))


def _sequence(items: list) -> str:
    return "".join(_text(op, value) for op, value in items)


def _text(op: object, value: object) -> str:
    match str(op):
        case "LITERAL":
            return chr(value)
        case "NOT_LITERAL":
            return "b" if value == ord("a") else "a"
        case "ANY":
            return "a"
        case "IN":
            return _member(value)
        case "BRANCH":
            return _sequence(value[1][0])
        case "SUBPATTERN":
            return _sequence(value[3])
        case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
            return value[0] * _sequence(value[2])
        case "ASSERT":
            return _sequence(value[1])
    return ""  # anchors and word edges


def _member(options: list) -> str:
    first = {"CATEGORY_DIGIT": "1", "CATEGORY_WORD": "a", "CATEGORY_SPACE": " "}
    if str(options[0][0]) == "NEGATE":
        return next(c for c in "az19/ " if all(not _holds(o, c) for o in options[1:]))
    op, value = options[0]
    match str(op):
        case "RANGE":
            return chr(value[0])
        case "CATEGORY":
            return first[str(value)]
    return chr(value)


def _holds(option: tuple, char: str) -> bool:
    op, value = str(option[0]), option[1]
    if op == "RANGE":
        return value[0] <= ord(char) <= value[1]
    if op == "CATEGORY":
        return {"CATEGORY_DIGIT": char.isdigit(), "CATEGORY_WORD": char.isalnum(), "CATEGORY_SPACE": char.isspace()}.get(str(value), False)
    return value == ord(char)
