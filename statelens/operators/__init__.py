"""DataFrame operators: capture, histograms, metrics, training analytics."""
