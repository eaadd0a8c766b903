"""DataFrame operators: parse, compare, link, pair, measure."""
