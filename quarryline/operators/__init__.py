"""Markets, samples, scores and tests as DataFrame functions."""
