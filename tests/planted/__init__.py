"""Operators on planted rows: a function gives rows, its SQL says which they must be."""

CASES = {}


def case(sql):
    def register(f):
        CASES[f.__name__] = (f, sql)
        return f

    return register
