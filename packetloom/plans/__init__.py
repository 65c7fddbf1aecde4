"""Plan shapes that keep exact results when one key holds a large share of the rows."""
