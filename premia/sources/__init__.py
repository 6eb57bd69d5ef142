"""Reading and writing portfolios, rate tables, tariffs and whole pipelines."""
