"""From raw inputs to finished tables: names, pair corpora, training sets."""
