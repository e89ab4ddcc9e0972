"""Rows that operators must take as they are."""

#: Nulls, empties, blanks, repeated rows, ties, odd letters and very long texts.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (5, "One two"), (6, "a b c d e f g"),
    (7, "a b c d e f g"), (8, "A B C D E F G"), (9, "日本語 テスト\x1cx ١٢٣ é"), (10, "word " * 30000), (11, "x" * 50000),
    (None, "a b c d e f g"), (None, None), (12, "a\x00b <|endoftext|> ’"),
]
