"""Shared by the operators' tests; the session is the one of tests/conftest.py."""


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
