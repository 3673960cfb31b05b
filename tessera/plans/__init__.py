"""Statement text to syntax trees and back, and name resolution."""
