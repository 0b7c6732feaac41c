"""DataFrame operators: scanning, classification, policy, registry, guard, signatures, reports and accuracy."""
