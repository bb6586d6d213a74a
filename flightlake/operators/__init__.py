"""DataFrame operators on ordered episodes."""
