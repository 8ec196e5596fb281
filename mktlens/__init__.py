"""Analytics over trades, order books, wallets and market resolutions, as Spark transformations."""
