def rows(df):
    return df.collect()


def one(df):
    return df.first()[0]


def sets(df):
    return {tuple(r) for r in df.collect()}
