"""Inputs shared by the tests of the operators."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty, blank and very long texts, ties and repeated rows, odd characters.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "word"),
    (None, None), (6, "x" * 60_000), (7, "alpha beta gamma delta\n" * 4000), (8, "123 ... !!"),
    (9, "Ünïcode Σας <|endoftext|> 日本\x1c語 é \U0001f389"), (10, "A b C"), (11, "a B c"),
]
