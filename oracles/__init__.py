"""SQL pieces shared by the oracle texts."""
