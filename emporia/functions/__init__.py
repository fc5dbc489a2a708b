from emporia.functions.dates import month_start, season
from emporia.functions.numbers import cents, py_round
from emporia.functions.text import plain_words, quoted_names

__all__ = ["cents", "month_start", "plain_words", "py_round", "quoted_names", "season"]
