"""DataFrame-in / DataFrame-out jobs of the domain."""
