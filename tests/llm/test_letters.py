from pixelspark.llm import langid


def test_signs_are_no_words_at_any_length():
    for n in (1, 16, 17, 400):
        assert langid.words_of("² " * n) == [] and langid.words_of("½ ² " * n + "one") == ["one"]
