"""DataFrame operators: preparation, sampling, nearest centre, cost, rounds."""
