"""DataFrame -> DataFrame operators over the contract model."""
