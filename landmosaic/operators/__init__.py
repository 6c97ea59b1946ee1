"""DataFrame operators over points, rasters, envelopes, samples and scores."""
