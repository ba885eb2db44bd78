"""Rules, thresholds, suites, results and alerts as DataFrame plans."""
